"""Results are replaced as a whole, or not at all."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from termscan import queries
from termscan.operators.reconcile import HIT_COLUMNS
from termscan.sources import sinks, trees


def hits_of(spark, *terms, fail=False):
    rows = spark.createDataFrame([(t, "r", f"/r/{t}.md", ".md", "Unknown", 1, "line") for t in terms],
                                 "term string, repo string, file string, ext string, bucket string, frequency int, context string")
    if not fail:
        return rows
    broken = F.when(F.col("term") == terms[-1], F.raise_error(F.lit("cut"))).otherwise(F.col("term"))
    return rows.repartition(2, "term").withColumn("term", broken).select(*HIT_COLUMNS)


def terms_in(table):
    return sorted(r.term for r in table.collect())


SINKS = {
    "parquet": (sinks.write_hits, lambda spark, path: terms_in(spark.read.parquet(path))),
    "csv": (sinks.write_hits_csv, lambda spark, path: terms_in(trees.read_hits(spark, path))),
    "sorted": (sinks.write_hits_csv_sorted, lambda spark, path: terms_in(trees.read_hits(spark, path))),
    "lines": (
        lambda hits, path: sinks.write_lines(hits.select(F.length("term").alias("line_no"), F.col("term").alias("line")), path),
        lambda spark, path: sorted(r.value for r in spark.read.text(path).collect()),
    ),
}


@pytest.mark.parametrize("sink", sorted(SINKS))
def test_a_job_that_fails_leaves_the_former_result(spark, tmp_path, sink):
    write, read = SINKS[sink]
    path = str(tmp_path / "out")
    write(hits_of(spark, "a", "b"), path)
    assert read(spark, path) == ["a", "b"]
    with pytest.raises(PySparkException):
        write(hits_of(spark, "c", "d", "e", fail=True), path)
    assert read(spark, path) == ["a", "b"]
    write(hits_of(spark, "f"), path + "/")
    assert read(spark, path) == ["f"]
    assert os.listdir(tmp_path) == ["out"]


def test_a_result_can_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "out")
    kept = sinks.write_hits(hits_of(spark, "a", "b"), path)
    assert terms_in(sinks.write_hits(kept.where("term = 'a'"), path)) == ["a"]


def test_the_manifest_names_the_files(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_hits(hits_of(spark, "a", "b"), path)
    named = json.loads((tmp_path / "out" / sinks.MANIFEST).read_text())
    assert named == {p.name: p.stat().st_size for p in (tmp_path / "out").glob("part-*")} and named


@pytest.mark.parametrize("lost", ["before the renames", "between the renames", "after the renames", "between, with a cut file"])
def test_a_driver_lost_while_replacing(spark, tmp_path, lost):
    path, new, old = tmp_path / "out", tmp_path / "_new-out", tmp_path / "_old-out"
    sinks.write_hits(hits_of(spark, "new"), str(new))
    sinks.write_hits(hits_of(spark, "former"), str(old))
    if lost == "before the renames":
        os.rename(old, path)
    elif lost == "after the renames":
        os.rename(new, path)
    elif lost == "between, with a cut file":
        part = next(new.glob("part-*"))
        os.truncate(part, part.stat().st_size - 1)
    sinks.finish_replacing(spark, str(path))
    want = "new" if lost in ("between the renames", "after the renames") else "former"
    assert terms_in(spark.read.parquet(str(path))) == [want]
    assert os.listdir(tmp_path) == ["out"]


def test_nothing_is_done_without_leftovers(spark, tmp_path):
    sinks.finish_replacing(spark, str(tmp_path / "nowhere"))
    assert os.listdir(tmp_path) == []


def test_text_tree_lies_as_sparks_own(spark, tmp_path):
    """The same folders and lines as the partitioned text writer, and nothing but one file in each folder."""
    rows = [("a", 1, "one"), ("a", 1, "two"), ("a", 1, "two"), (None, 1, "none"), ("", 1, "empty"), ("a/b=c%d é.[x]", 2, "odd"),
            ("..", None, "ünï\nlines"), ("b", 3, None), ("b", 4, "")]
    lines = spark.createDataFrame(rows, "kind string, no long, text string").repartition(3)
    ours, theirs = tmp_path / "ours", tmp_path / "theirs"
    assert sinks.write_text_tree(lines, str(ours), ["kind", "no"]) == 6
    lines.repartition("kind", "no").write.partitionBy("kind", "no").text(str(theirs))

    def held(root):
        return {str(f.parent.relative_to(root)): sorted(f.read_text().splitlines()) for f in root.rglob("part-*.txt")}

    assert held(ours) == held(theirs)
    assert sum(f.is_file() for f in ours.rglob("*")) == 6
    assert sinks.write_text_tree(lines.limit(0), str(tmp_path / "none"), ["kind", "no"]) == 0
    assert (tmp_path / "none").is_dir()


def test_document_tree_holds_a_file_per_document_only(spark, small_dir):
    documents = spark.read.parquet(f"{small_dir}/documents.parquet")
    listing = trees.walk_tree(spark, [queries.document_tree(spark, small_dir)])
    assert listing.count() == documents.count()
