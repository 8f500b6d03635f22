from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termscan.llm import substrings, texts


def expected(rows, window):
    """Kept words of each row by brute force; a null id is larger than all."""
    tokens = [(1 << 62 if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in tokens:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in tokens:
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_equals_brute_force(odd_documents, odd_texts):
    for window in (50, 3):
        got = substrings.remove_repeats(odd_documents, window).select("doc_id", "n_words", "n_removed", "kept").collect()
        want = [(i, *rest) for (i, _), rest in zip(odd_texts, expected(odd_texts, window))]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table_and_carried_columns(no_documents, odd_documents):
    assert substrings.remove_repeats(no_documents).count() == 0
    carried = substrings.remove_repeats(odd_documents, carry=["lang"])
    assert carried.columns == ["doc_id", "text", "lang", "kept", "n_words", "n_removed"]
    assert {r["lang"] for r in carried.collect()} == {"xx"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \t\né ", max_size=40)), max_size=12), st.integers(1, 60))
def test_chunks_cut_words_like_a_split(column, limit):
    got = []
    for chunk in texts.chunks(pa.array(column, pa.string()), limit):
        data = chunk.data.tobytes()
        for a, b in zip(chunk.word_bounds[:-1], chunk.word_bounds[1:]):
            got.append([data[s:e] for s, e in zip(chunk.starts[a:b], chunk.ends[a:b])])
    assert got == [texts.words(t) for t in column]


def test_equal_words_and_windows_have_equal_hashes():
    chunk = next(texts.chunks(pa.array(["ab cd ab cd ab", "cd ab"])))
    h = chunk.word_hashes()
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] == h[5] and h[0] != h[1]
    w = texts.window_hashes(h, 2, texts.WINDOW_BASES[0])
    assert w[0] == w[2] and w[1] == w[3] and w[0] != w[1]


def test_sliding_minimum():
    values = np.array([5, 3, 8, 1, 9, 7], np.uint64)
    assert substrings.sliding_minimum(values, 3).tolist() == [3, 1, 1, 1]
    assert substrings.sliding_minimum(values, 1).tolist() == values.tolist()
