"""Encoding, record files, packing and attribution against the tokenizers' own ``encode``."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termscan.llm import attribution, packing, records, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = (tokens.tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def direct(path, text):
    ids = tokens.encoder(path, path == WORD).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


ODD = [None, "", " ", "\n", "a", "It's we'll 'S don''t", " a  b ", "a\n\nb \n c", "x y", "a  b", "Σας ΑΣ", "İx", "日本 語", "é́", "1²3½ 4",
       "<|endoftext|>a b<|startoftext|>", "tab\tand\r\nreturn", "a\x1cb", "Ünïcödé's œuvre", "\x00 a", "!!! ?? a,b", "3.14 and 10,000"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_odd_texts_encode_as_a_whole(path):
    assert tokens.encoder(path, path == WORD).encode(ODD) == [direct(path, t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abS'tlé1²,. \n\t ß—Σ<|"), max_size=30))
def test_any_text_encodes_as_a_whole(text):
    for path in (WORD, BYTE):
        assert tokens.encoder(path, path == WORD).encode([text]) == [direct(path, text)]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    made = tokens.Encoder(BYTE, False)
    texts = ["one two three four five", "six seven eight", "one two"] * 2
    assert made.encode(texts) == [direct(BYTE, t) for t in texts]


def test_words_of_letters_are_remembered_once():
    made = tokens.Encoder(BYTE, False)
    texts = ["plain words über all", "über plain\nwords, all", "ʼn ǆ ª plain"]
    assert made.encode(texts) == [direct(BYTE, t) for t in texts]
    assert "über" in made.pieces and not {" words", " über", " all", " plain"} - {" words"} & set(made.pretokens)


def counted(made, monkeypatch):
    """What the encoder gives to the tokenizer's model from here on."""
    seen, encode = [], made._pretoken
    monkeypatch.setattr(made, "_pretoken", lambda text: seen.append(text) or encode(text))
    return seen


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_before_punctuation_are_encoded_once(path, monkeypatch):
    made = tokens.Encoder(path, path == WORD)
    seen = counted(made, monkeypatch)
    text = "a über über, über. über%%% über!"
    assert made.encode([text]) == [direct(path, text)]
    assert seen.count(("" if path == WORD else " ") + "über") == 1
    texts = ["x über'. it's, 's (über) über_a_ don't?' l'l ²über, über² über\u00bb,", "x ...\nüber, über."]
    assert made.encode(texts) == [direct(path, t) for t in texts]


def test_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    made = tokens.Encoder(BYTE, False)
    seen = counted(made, monkeypatch)
    texts = [f"x kept {'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(100)]
    assert made.encode(texts) == [direct(BYTE, t) for t in texts]
    assert seen.count(" kept") == 1 and len(made.pieces) + len(made.older) <= 24


def test_records_round_trip(odd_documents, odd_texts, tmp_path):
    index = records.with_start(records.write_records(odd_documents, WORD, end_id=2, folder=f"file://{tmp_path}/r"))
    read = {(r["file"], r["row"]): r for r in records.read_records(index).collect()}
    rows = sorted(index.collect(), key=lambda r: (r["part"], r["row"]))
    end = (2).to_bytes(4, "little")
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    position = 0
    for row in rows:
        found = read[row["file"], row["row"]]
        assert row["start"] == position and found["doc_id"] == row["doc_id"]
        assert len(found["ids"]) == 4 * row["n_tokens"] and found["ids"].endswith(end)
        position += row["n_tokens"]
    want = sorted((repr(i), direct(WORD, t) + end) for i, t in odd_texts)
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in read.values()) == want


def test_records_of_nothing(no_documents, tmp_path):
    index = records.write_records(no_documents, WORD, end_id=2, folder=f"file://{tmp_path}/r")
    assert records.with_start(index).count() == 0 and records.read_records(index).count() == 0


def test_damage_is_found():
    framed = records.frame(b"payload")
    assert records.unframe(framed) == b"payload"
    for at in range(len(framed)):
        with pytest.raises(ValueError):
            records.unframe(framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1 :])


def test_packing_is_whole(odd_documents, odd_texts):
    rows = packing.pack(odd_documents, BYTE, end_id=0, capacity=64).collect()
    documents: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in rows:
        documents.setdefault(r["row"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    got = []
    for parts in documents.values():
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == list(np.cumsum([0, *(r["length"] for r in parts)])[:-1])
        got.append((repr(parts[0]["doc_id"]), b"".join(tokens.widened(bytes(r["ids"]), r["width"]) for r in parts)))
        assert all(4 * r["doc_tokens"] == len(got[-1][1]) for r in parts)
    assert sorted(got) == sorted((repr(i), direct(BYTE, t) + bytes(4)) for i, t in odd_texts)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == list(np.cumsum([0, *(r["length"] for r in parts)])[:-1])
        assert sum(r["length"] for r in parts) <= 64


def test_packing_of_nothing(no_documents):
    assert packing.pack(no_documents, BYTE, end_id=0).count() == 0


def test_digests_are_of_four_byte_ids(odd_documents):
    cut = packing.pieces(odd_documents, BYTE, end_id=0)
    for a, b in zip(*[sorted(d.collect(), key=lambda r: (r["row"], r["start"])) for d in (cut, packing.digests(cut))]):
        assert b["ids_crc32"] == zlib.crc32(tokens.widened(bytes(a["ids"]), a["width"]))


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=12))
def test_plans_cover_their_histogram(histogram):
    plan = packing.plan_packing(histogram, 32)
    content = np.zeros(plan.sequences, int)
    for length, first, last, sequence, offset in zip(plan.length, plan.first, plan.last, plan.sequence, plan.offset):
        content[sequence : sequence + last - first] += length
    assert (content <= 32).all() and content.sum() == sum(k * v for k, v in histogram.items())


def test_column_generation_finds_the_optimum():
    # 3 + 3 + 4 and 5 + 5 fill ten exactly
    plan = packing.plan_packing({3: 20, 4: 10, 5: 30}, 10)
    assert plan.sequences == 25
    value, counts = packing.best_pattern(np.array([0.3, 0.4, 0.5]), np.array([3, 4, 5]), 10)
    assert value == pytest.approx(1.0) and counts @ np.array([3, 4, 5]) <= 10
    assert packing.padding(512) == 0 and packing.padding(1024) == 0 and packing.padding(1000) == 24


def sections(rows):
    return sorted((repr(r["doc_id"]), r["section"], r["start"], r["n_chars"], r["n_tokens"]) for r in rows)


def test_lines_hold_all_tokens(odd_documents, odd_texts):
    whole = sum(len(direct(BYTE, t)) // 4 for _, t in odd_texts)
    for rule in attribution.RULES:
        rows = attribution.section_tokens(odd_documents, BYTE, rule=rule).collect()
        assert sum(r["n_tokens"] for r in rows) == pytest.approx(whole)
        assert sum(r["n_chars"] for r in rows) == sum(len(t or "") for _, t in odd_texts)


def test_rules_at_a_boundary(spark):
    """' bc' is one token from byte 1 to 4; the sections meet inside it."""
    table = spark.createDataFrame([(1, "a bc"), (2, None), (3, "a bc")], "doc_id long, text string")
    from pyspark.sql import functions as F

    spans = F.expr("array(named_struct('start', 0, 'end', 2), named_struct('start', 2, 'end', 9), named_struct('start', 3, 'end', 1))")
    want = {"first": [2, 0, 0], "last": [1, 1, 0], "share": [1 + 1 / 3, 2 / 3, 0]}
    for rule, counts in want.items():
        rows = sorted(attribution.section_tokens(table, BYTE, spans, rule).collect(), key=lambda r: (r["doc_id"], r["section"]))
        assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 3)] == pytest.approx(counts * 2)
        assert [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [0, 0, 0]
    assert [r["n_crossing"] for r in rows if r["doc_id"] == 1] == [1, 0, 0]
    with pytest.raises(ValueError):
        attribution.section_tokens(table, BYTE, rule="other")


def test_sections_of_nothing(no_documents):
    assert attribution.section_tokens(no_documents, BYTE).count() == 0
