"""Quality rules, language model and tiling."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termscan.llm import boosting, features, hmm, quality, tiling


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


TEXTS = ["a b\na b\n\n a b\na b", "x\n", "\n\n", "one two three four five one two three four five six", "# | $$ <é>\r\n# | $$ <é>\r\n", "a" * 5000]


def test_statistics_equal_brute_force(spark, odd_documents, odd_texts):
    rows = odd_texts + list(enumerate(TEXTS, 50))
    table = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(TEXTS, 50)), "doc_id long, text string"))
    got = features.document_statistics(table).select("doc_id", *features.COUNTS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *base_counts(t))) for i, t in rows)


def test_quality_is_learned_and_nothing_else_is_needed(spark, no_documents, odd_documents):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 300}{'#$%' if i % 2 else ''}" for j in range(60))) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (70, None)], "doc_id long, quality int")
    forest = quality.train_quality(table, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(table, forest).collect()}
    assert all(kept[i] == (i % 2 == 0) for i in range(60, 80))
    without = quality.train_quality(odd_documents, labels.limit(0))
    judged = quality.judge(odd_documents, without).collect()
    assert all(r["kept"] != r["base_failed"] for r in judged) and len(judged) == odd_documents.count()
    assert quality.judge(no_documents, forest).count() == 0
    with pytest.raises(ValueError):
        quality.judge(odd_documents, forest, carry=["n_words"])


def test_forest_is_monotone_and_accurate():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(2000)) < 0.6).astype(float)
    forest = boosting.train(x[:1500], y[:1500], np.array([-1, 0, 0]))
    assert ((forest.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.85
    grid = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
    grid[:, :, 0] = np.linspace(0, 1, 40)
    scores = forest.score(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-9).all()


def likelihood(model, symbols):
    state = model.start * model.emit[symbols[0]]
    for s in symbols[1:]:
        state = (state @ model.move) * model.emit[s]
    return math.log10(state.sum())


def random_model(states, symbols, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))).T.copy())


def test_scaled_recursion_is_exact():
    model = random_model(3, 7)
    rng = np.random.default_rng(1)
    sequences = sorted((rng.integers(0, 7, n) for n in (30, 12, 12, 5, 1)), key=len, reverse=True)
    sizes = np.array([len(s) for s in sequences])
    got = hmm.sequence_log10(model, np.concatenate(sequences), np.cumsum(sizes) - sizes, sizes)
    assert got == pytest.approx([likelihood(model, s) for s in sequences])


def test_training_raises_the_likelihood():
    model, truth = random_model(2, 5, 4), random_model(2, 5, 5)
    rng = np.random.default_rng(2)
    sequences = [rng.choice(5, 40, p=truth.emit[:, i % 2]) for i in range(30)]
    symbols, sizes = np.concatenate(sequences), np.full(30, 40)
    begin = np.cumsum(sizes) - sizes
    last = -math.inf
    for _ in range(6):
        total = hmm.sequence_log10(model, symbols, begin, sizes).sum()
        assert total >= last - 1e-3
        last = total
        counts = hmm.expected_counts(model, symbols, begin, sizes)
        assert counts[6:].sum() == pytest.approx(len(symbols), rel=1e-4)
        start, move, emit = counts[:2], counts[2:6].reshape(2, 2), counts[6:].reshape(2, 5)
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), (emit / emit.sum(1, keepdims=True)).T.copy())


def test_scores_equal_brute_force_base(odd_documents, odd_texts, no_documents, monkeypatch):
    monkeypatch.setattr(hmm, "SHARED_WORDS", 40)  # so that some words are joined
    monkeypatch.setattr(hmm, "OWN_WORDS", 20)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "\n"]) for i, t in odd_texts]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, ws in tokens
    )
    got = hmm.score_documents(odd_documents, states=2, rounds=2).collect()
    assert sorted((repr(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.score_documents(no_documents, states=2, rounds=1).count() == 0


def test_model_beats_the_base_on_held_out(spark, small_dir):
    documents = spark.read.parquet(f"{small_dir}/documents.parquet")
    held = [r for r in hmm.score_documents(documents, rounds=3).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_tiles(document, item, least):
    """Greedy tiles straight from the definition: covered words of the item."""
    d, i, covered = [True] * len(document), [True] * len(item), 0
    while True:
        best = 0, 0, 0
        for a in range(len(item)):
            for b in range(len(document)):
                n = 0
                while a + n < len(item) and b + n < len(document) and i[a + n] and d[b + n] and item[a + n] == document[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return covered
        i[a : a + n], d[b : b + n] = [False] * n, [False] * n
        covered += n


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        document, item = (rng.integers(0, 3, n).astype(np.uint64) for n in (rng.integers(0, 40), rng.integers(0, 20)))
        tiles = tiling.tile(document, item, 3)
        for at, other, n in tiles:
            assert (document[at : at + n] == item[other : other + n]).all()
        assert sum(n for _, _, n in tiles) == brute_tiles(document.tolist(), item.tolist(), 3)


ITEM = "Alpha beta gamma delta epsilon, zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho"


def test_reordered_passages_are_leaks(spark, no_documents):
    moved = "Lambda mu nu xi omicron pi rho; then zeta ETA theta iota kappa - and alpha beta gamma delta epsilon."
    rows = [(1, f"before {ITEM} after"), (2, moved), (2, moved), (3, "alpha beta gamma delta"), (None, ITEM), (5, None), (6, ""), (7, "short one here")]
    documents = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, item_id int, lang string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "Short one"), (None, "")], "item_id long, text string")
    for block_bytes in (1 << 20, 40):  # also in several blocks
        got = sorted(repr((r["doc_id"], r["item_id"])) for r in tiling.leaks(documents, items, block_bytes=block_bytes).collect())
        assert got == sorted(map(repr, [(1, 10), (2, 10), (2, 10), (None, 10), (7, 12)]))
        kept = tiling.without_leaks(documents, items, block_bytes=block_bytes).collect()
        assert sorted(r["doc_id"] for r in kept) == [3, 5, 6]
    assert tiling.leaks(documents, items.limit(0)).count() == 0
    assert tiling.leaks(no_documents, items).count() == 0
    assert tiling.without_leaks(no_documents, items).count() == 0


def test_sample_is_bounded_with_repeated_ids(spark):
    rows = [(7, f"text {i} of many") for i in range(300)] + [(i, f"single {i}") for i in range(100, 110)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1)] * 5 + [(i, i % 2) for i in range(100, 110)], "doc_id long, quality int")
    x, y = quality.labelled_features(documents, labels)
    assert x.shape[0] == len(y) == 11
    again, _ = quality.labelled_features(documents.orderBy(F.desc("text")), labels)
    assert (x == again).all()
