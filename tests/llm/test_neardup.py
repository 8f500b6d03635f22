from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from termscan.llm import neardup
from termscan.llm.components import components


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def links(rows):
    sets = [shingles(t) for _, t in rows]
    return [
        [j for j, b in enumerate(sets) if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)
    ]


def test_equals_brute_force(odd_documents, odd_texts):
    found = links(odd_texts)
    classes = list(range(len(odd_texts)))
    for _ in classes:
        classes = [min([classes[i], *(classes[j] for j in found[i])]) for i in range(len(classes))]
    want = []
    for i, (doc_id, text) in enumerate(odd_texts):
        ids = [odd_texts[j][0] for j in range(len(odd_texts)) if classes[j] == classes[i] and odd_texts[j][0] is not None]
        own = shingles(text)
        others = {frozenset(shingles(odd_texts[j][1])) for j in found[i]} - {frozenset(own)}
        want.append((doc_id, min(ids) if own and ids else doc_id, len(found[i]), len(others), len(own)))
    got = neardup.near_duplicates(odd_documents).drop("id", "keeper_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(no_documents):
    assert neardup.near_duplicates(no_documents).count() == 0


def test_large_groups_in_small_cells(spark, monkeypatch):
    """A group cut into many cells has the same links as by brute force."""
    monkeypatch.setattr(neardup, "BUCKET_CHUNK", 4)
    monkeypatch.setattr(neardup, "CELL_DOCUMENTS", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 20])) for i in range(40)] + [(100 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(5)]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (doc_id, _), found in zip(rows, links(rows)):
        assert got[doc_id]["n_links"] == len(found)
        assert got[doc_id]["class_id"] == (doc_id if doc_id >= 100 else 0)


def test_posterior_bound():
    least = neardup.least_matches(Fraction(4, 5), 1e-8)
    assert len(least) == 8 and least == sorted(least) and least[0] > 0
    sig = np.random.default_rng(0).integers(0, 1 << 16, (4, 128)).astype(np.uint16)
    sig[1] = sig[0]
    sig[2, :110] = sig[0, :110]
    assert neardup.survivors(sig, 0, np.array([1, 2, 3]), least).tolist() == [1, 2]


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 6)], [(i, i + 1) for i in range(40)]])
def test_components(spark, edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root
