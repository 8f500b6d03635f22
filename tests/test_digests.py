"""Reconciliation by digests equals reconciliation of all rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from termscan.operators import digests, reconcile
from termscan.sources import sinks

HITS = "term string, repo string, file string, ext string, bucket string, frequency int, context string"


def hit(term="t", repo="r", file="/f", bucket="Code", frequency=1, context="c"):
    return (term, repo, file, ".md", bucket, frequency, context)


def plenty(seed):
    chosen = random.Random(seed)
    return [hit(f"t{chosen.randrange(40)}", file=f"/{chosen.randrange(30)}", frequency=chosen.randrange(3)) for _ in range(400)]


BASE = [hit("a", file="/1"), hit("b", file="/1"), hit("c", file="/2"), hit("c", file="/2")]
HOT = [hit("hot")] * 200
PAIRS = {
    "equal": (BASE, BASE[::-1]),
    "one missing": (BASE, BASE[1:]),
    "copies": (BASE, BASE[:3]),
    "hot": (BASE + HOT, BASE + HOT[1:]),
    "nulls": ([hit(None, repo="x")], [hit("x", repo=None)]),
    "null and empty": ([hit(context=None)], [hit(context="")]),
    "empty": ([], []),
    "one empty": ([], BASE),
    "long": ([hit(context="x" * 100_000)], [hit(context="x" * 99_999 + "y")]),
    "plenty": (plenty(1), plenty(2)),
    "nearly equal": (plenty(3), plenty(3)[:-1] + [hit("new")]),
}


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.fixture
def table(spark):
    return lambda given: spark.createDataFrame(given, HITS)


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_as_over_all_rows(spark, table, tmp_path, name):
    left, right = map(table, PAIRS[name])
    want = rows(reconcile.row_differences(left, right))
    assert rows(digests.row_differences(left, right)) == want
    assert rows(digests.column_differences(left, right)) == rows(reconcile.column_differences(left, right))
    places = [f"{tmp_path}/{side}" for side in ("left", "right")]
    for hits, place in zip((left, right), places):
        sinks.write_hits_with_digests(hits, place)
    assert rows(digests.stored_differences(spark, *places)) == want
    counts = (left.count(), right.count(), not want)
    assert tuple(digests.stored_equality(spark, *places).first()) == counts
    assert tuple(reconcile.equality(left, right).first()) == counts


def test_types_and_further_columns_take_no_part(spark, table, tmp_path):
    left = table(BASE)
    right = left.withColumns({"frequency": F.col("frequency").cast("bigint"), "cell": F.lit(1), "node": F.lit("n")})
    assert rows(digests.row_differences(left, right)) == []
    assert rows(digests.column_differences(right, left)) == []
    places = [f"{tmp_path}/{side}" for side in ("left", "right")]
    for hits, place in zip((left, right), places):
        digests.store(hits, place)
    assert digests.differing_cells(spark, *places) == []


def test_only_rows_of_differing_cells_are_fetched(spark, table, tmp_path):
    left, right = map(table, PAIRS["nearly equal"])
    places = [f"{tmp_path}/{side}" for side in ("left", "right")]
    for hits, place in zip((left, right), places):
        digests.store(hits, place, parts=3)
    cells = digests.differing_cells(spark, *places)
    assert len(cells) == 2
    nodes = {c >> digests.NODE_BITS for c in cells}
    # Every other folder may hold anything: it is not read.
    for place in places:
        for folder in os.listdir(f"{place}/rows"):
            if folder.startswith("node=") and int(folder[5:]) not in nodes:
                for file in os.listdir(f"{place}/rows/{folder}"):
                    with open(f"{place}/rows/{folder}/{file}", "wb") as spoiled:
                        spoiled.write(b"spoiled")
    assert rows(digests.stored_differences(spark, *places)) == rows(reconcile.row_differences(left, right))


def test_the_tree_sums_its_cells(spark, table):
    leaves = digests.cell_digests(table(plenty(5)))
    levels = digests.tree(leaves).groupBy("level").agg(*[F.sum(c).alias(c) for c in digests.SUMS]).orderBy("level").collect()
    whole = leaves.agg(*[F.sum(c) for c in digests.SUMS]).first()
    assert [tuple(r)[1:] for r in levels] == [tuple(whole)] * 3
