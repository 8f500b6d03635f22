"""Whitening and hard negatives against plain computations."""

from __future__ import annotations

import math

import numpy as np
import pytest

from termscan.llm import negatives, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, key string, rank int, x int, positives string"
NAN, INF = float("nan"), float("inf")


def _odd_rows(rng, n=240, width=6):
    """Vectors with ties, repeats and zero vectors; and such as take no part."""
    rows = []
    for i in range(n):
        vector = rng.normal(size=width).round(1).astype(np.float32).tolist() if i % 11 else [0.0] * width
        rows.append((i, vector, int(rng.integers(0, 3)) if i % 17 else 0))
    rows += [(40, rows[40][1], rows[40][2]), (41, rows[41][1], rows[41][2]), (41, rows[41][1], rows[41][2]), (None, rows[3][1], 1), (None, None, 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [NAN] + [0.0] * (width - 1), 1), (903, [None] + [0.0] * (width - 1), 1)]
    rows += [(904, [INF] + [0.0] * (width - 1), 1), (905, [1.0] * (width + 1), 1), (1000, rows[5][1], None)]
    return rows


@pytest.fixture(scope="module")
def odd_rows():
    return _odd_rows(np.random.default_rng(3))


@pytest.fixture(scope="module")
def odd_table(spark, odd_rows):
    return spark.createDataFrame([(*r, -1, "k", -2, -3, "p") for r in odd_rows], SCHEMA).repartition(5)


def _usable(rows, width=6):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def _check_whitening(found, ids, x, components):
    n = len(x)
    mean = x.sum(0) / n
    covariance = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    by_id: dict = {}
    for row in found:
        by_id.setdefault(row["vec_id"], {}).setdefault(row["component"], []).append(row)
    assert len(found) == n * components
    signs = {}
    for i, vector in zip(ids, x):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(vector, x.sum(0)))
        for j in range(components):
            want = (vector - mean) @ vectors[:, j] / np.sqrt(values[j])
            row = min(by_id[i][j + 1], key=lambda r: abs(abs(r["whitened"]) - abs(want)))
            if abs(want) > 1e-3:
                signs.setdefault(j, np.sign(want * row["whitened"]))
                assert row["whitened"] * signs[j] == pytest.approx(want, abs=1e-8)
            assert (row["n"], row["deviation"]) == (n, deviation) or i is None or len(by_id[i][j + 1]) > 1
            assert row["explained"] == pytest.approx(values[j] / np.trace(covariance), rel=1e-9)
            assert row["identity_error"] < 1e-9


def test_whitening_equals_an_eigendecomposition(odd_table, odd_rows):
    usable = _usable(odd_rows)
    x = np.floor(64 * np.array([r[1] for r in usable], np.float32).astype(float)).astype(np.int64) + 1_000_000
    _check_whitening(whitening.whitened(odd_table).collect(), [r[0] for r in usable], x, 6)


def test_whitening_query(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 1_000_000
    frame = queries.op12_embedding_whitening(spark, small_dir)
    assert frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(frame.dtypes)["component"] == "int"
    _check_whitening(frame.collect(), [r["vec_id"] for r in rows], x, 32)


def test_only_as_many_components_as_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 20
    assert found[0]["explained"] == pytest.approx(1)
    for few in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)] * 3):
        assert whitening.whitened(spark.createDataFrame(few, "vec_id int, embedding array<float>, label int")).collect() == []


def test_equal_eigenvalues_and_wide_ranges():
    rng = np.random.default_rng(5)
    basis, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    wanted = np.array([1e12, 1e6, 5, 5, 5, 1, 1, 1e-2, 1e-2, 0, 0, 0])
    a = (basis * wanted) @ basis.T
    values, vectors = whitening.eigenpairs((a + a.T) / 2)
    assert np.allclose(values[:7], wanted[:7], rtol=1e-3)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)


def test_numbers_beyond_a_long_raise(spark):
    table = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(table).collect()


def _plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by scoring all pairs."""
    last = 1 << 62
    rows = [(r[0], r[2], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for r in _usable(rows) if r[2] is not None]
    anchors = {(i, label, tuple(x)) for i, label, x in rows if i is not None and i % 100 == 0}
    out = []
    for i, label, x in anchors:
        scored = [(sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in rows if j != i]
        scored.sort(key=lambda s: (-s[0], last if s[1] is None else s[1]))
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score]
            out += [(i, positive, k, j, score, low) for k, (low, j, _) in enumerate(window[:10], 1)]
    return out


@pytest.mark.parametrize("block, chunk", [(2048, 48 << 20), (1, 500)])
def test_negatives_equal_all_pairs(odd_table, odd_rows, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "CHUNK_BYTES", chunk)
    found = negatives.hard_negatives(odd_table.withColumnRenamed("embedding", "vector")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, _plain_negatives(odd_rows)))
    assert len(found) > 50


def test_no_anchors_no_rows(spark):
    schema = "vec_id long, label int, vector array<float>"
    for rows in ([], [(1, 1, [1.0]), (2, 1, [1.0])], [(100, 1, [1.0])], [(100, 1, None)]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect() == []


def test_scores_stay_within_their_bounds():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for scale in (1, 300, 2.0**24):
        x = np.floor(rng.normal(size=(400, 8)) * scale)
        x[0] = 0
        x[1] = -x[2]
        directions = rng.normal(size=(5, 8))
        directions[0] = x[3]
        directions /= np.linalg.norm(directions, axis=1)[:, None]
        measured = next(negatives._measure(8, directions)(iter([pa.record_batch(
            [pa.array(range(400)), pa.array([0] * 400), pa.array((x / 256).tolist())], names=["vec_id", "label", "vector"]
        )])))
        rows = negatives.Rows([measured], 8, 5)
        for i in range(20):
            low, high = rows.bounds(rows.cos[:, i], rows.sin[:, i], rows.norm[i], slice(None))
            scores = [sum(int(a) * int(b) for a, b in zip(x[i], y)) for y in x]
            assert all(a <= s <= b for a, s, b in zip(low, scores, high))
            assert rows.scores(rows.x[i], rows.norm[i], np.arange(400)).tolist() == scores
