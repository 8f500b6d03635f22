"""File trees, encodings, rule files, sinks."""

from __future__ import annotations

import csv
import os
import re
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from termscan.operators.reconcile import HIT_COLUMNS, row_differences
from termscan.plans import scan
from termscan.queries import QUERIES
from termscan.sources import sinks, tables, trees, walk
from termscan.spec import ScanSpec, SpecError


@pytest.fixture
def tree(tmp_path):
    def write(name, content):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())

    write("proj/a.md", "Iris here\nplan for Iris | done\n")
    write("proj/deep/b.TXT", "no term, class only")
    write("proj/deep/c.txt", b"\xef\xbb\xbfiris with mark")
    write("proj/bad.txt", b"iris \xff\xfe broken \xc3")
    write("other/le.txt", "Iris ünï\n".encode("utf-16"))
    write("other/be.txt", b"\xfe\xff" + "IRIS be".encode("utf-16-be"))
    write("other/odd.txt", b"\xff\xfeI\x00r\x00i\x00s\x00!")
    write("other/wide.txt", "iris wide".encode("utf-32"))
    write("other/empty.md", "")
    write("other/skip.log", "iris")
    write("bin/x.md", "iris")
    write("bin/keep.md", "iris")
    write("big.md", "iris " * 300_000)
    write("SUMMARY.md", "iris")
    write(".scanignore", "# rules of this root\n**/bin/**\n!**/keep.md\n")
    return str(tmp_path / "root")


def relative(rows, root):
    return sorted(os.path.relpath(r.path, root) for r in rows)


def test_texts_are_decoded_by_mark_and_never_fail(spark, tree):
    texts = {os.path.relpath(r.path, tree): r.text for r in trees.read_tree(spark, [tree], ["txt"]).collect()}
    assert texts["proj/deep/c.txt"] == "iris with mark"
    assert texts["proj/bad.txt"] == "iris �� broken �"
    assert texts["other/le.txt"] == "Iris ünï\n"
    assert texts["other/be.txt"] == "IRIS be"
    assert texts["other/odd.txt"] == "Iris�"
    assert texts["other/wide.txt"] == "iris wide"
    assert "proj/deep/b.TXT" in texts
    assert spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "false"


def test_nested_and_missing_roots(spark, tree):
    roots = [tree + "/proj/deep", tree, tree + "/nowhere", "  "]
    once = trees.list_tree(spark, roots, ["txt"]).select("path").collect()
    twice = trees.list_tree(spark, roots, ["txt"], dedupe=False).select("path").collect()
    assert len(once) == len(set(once)) == 7
    assert len(twice) == 9
    assert trees.list_tree(spark, ["/nowhere/at/all"]).count() == 0


def test_size_limit_reaches_the_file_source_and_listing_reads_no_content(spark, tree):
    listed = trees.list_tree(spark, [tree])
    plan = listed.where("length <= 10").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "content" not in plan.split("ReadSchema")[-1]
    assert "LessThanOrEqual(length,10)" in listed.where("length <= 10")._jdf.queryExecution().toString()


def test_rule_lines_keep_their_order(spark, tree, tmp_path):
    extra = tmp_path / "extra.ignore"
    extra.write_text("second\n#c\nthird\n")
    lines = trees.rule_lines(spark, ["first"], [str(extra), str(tmp_path / "missing")], [tree])
    assert lines == ["first", "second", "#c", "third", "# rules of this root", "**/bin/**", "!**/keep.md"]


def test_an_unreadable_rule_file_is_passed_over_with_a_warning(spark, tree, tmp_path):
    (tmp_path / "folder.ignore").mkdir()
    with pytest.warns(UserWarning, match="folder.ignore"):
        assert trees.rule_lines(spark, ["first"], [str(tmp_path / "folder.ignore")], []) == ["first"]


def test_a_walk_finds_hidden_names_and_skips_pruned_directories(spark, tree):
    root = Path(tree)
    (root / "pkg").mkdir()
    (root / "pkg" / "__init__.py").write_text("iris")
    (root / "_drafts" / ".deep").mkdir(parents=True)
    (root / "_drafts" / ".deep" / "x.py").write_text("Iris iris")
    (root / "loop").symlink_to(root, target_is_directory=True)
    everything = relative(trees.walk_tree(spark, [tree]).collect(), tree)
    expected = sorted(os.path.relpath(os.path.join(d, f), tree) for d, _, names in os.walk(tree) for f in names)
    assert everything == expected
    assert {"pkg/__init__.py", "_drafts/.deep/x.py", ".scanignore", "other/empty.md"} <= set(everything)
    pruned = relative(trees.walk_tree(spark, [tree], "/(pkg|PROJ)$").collect(), tree)
    assert pruned == [p for p in expected if not p.startswith(("pkg/", "proj/"))]
    assert trees.walk_tree(spark, [tree, tree + "/pkg"], dedupe=False).count() == len(expected) + 1
    assert trees.walk_tree(spark, ["/nowhere/at/all"]).count() == 0

    spec = ScanSpec(include_paths=["file:" + tree], extensions=["py"], anchor_terms=["iris"])
    hits = scan.scan(spark, spec).hits
    assert sorted((r.repo, r.frequency) for r in hits.collect()) == [("_drafts", 2), ("pkg", 1)]
    assert scan.scan(spark, replace(spec, include_hidden=False)).hits.count() == 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_any_file_name_can_be_read(spark, tmp_path, scheme):
    names = ["a b.md", "c%20d.md", "e#f?.md", "ü \\ x.md", "-g:h.md"]
    for name in names:
        (tmp_path / name).write_text("iris " + name)
    listing = trees.walk_tree(spark, [scheme + str(tmp_path)])
    texts = {r.path: r.text for r in trees.read_listed(listing).collect()}
    assert texts == {f"{tmp_path}/{name}": "iris " + name for name in names}


def test_files_are_read_in_bounded_batches(spark, tree, monkeypatch):
    whole = {r.path: r.text for r in trees.read_listed(trees.walk_tree(spark, [tree])).collect()}
    monkeypatch.setattr(walk, "BATCH_BYTES", 1)
    pieces = {r.path: r.text for r in trees.read_listed(trees.walk_tree(spark, [tree])).collect()}
    assert whole == pieces and len(whole) == 15


def test_a_file_that_vanishes_is_skipped(spark, tree):
    listing = trees.walk_tree(spark, [tree]).where("path like '%.txt'")
    os.remove(tree + "/proj/deep/c.txt")
    assert len(trees.read_listed(listing).collect()) == 5


@pytest.mark.parametrize("hidden", [True, False])
def test_scan_of_a_tree(spark, tree, tmp_path, hidden):
    out = str(tmp_path / "out")
    spec = ScanSpec(
        include_paths=[tree], extensions=["*.md", "*.txt"], anchor_terms=["Iris", "IRIS", "absent"],
        planned_hints_regex="plan", code_hints_regex="class", max_file_mb=1, output_dir=out, include_hidden=hidden,
    )
    result = scan.write_reports(scan.scan(spark, spec), spec)
    hits = {os.path.relpath(r.file, tree): r for r in result.hits.collect()}
    assert sorted(hits) == ["bin/keep.md", "other/be.txt", "other/le.txt", "other/odd.txt", "other/wide.txt",
                            "proj/a.md", "proj/bad.txt", "proj/deep/c.txt"]
    assert tuple(hits["proj/a.md"])[:1] + tuple(hits["proj/a.md"])[3:] == ("Iris", ".md", "Planned", 2, "Iris here")
    assert hits["proj/deep/c.txt"].repo == "proj"
    assert [tuple(r) for r in result.tiers.collect()] == [("Iris", 9, 1.0, "Crest")]
    assert [r.items for r in result.summaries.buckets.collect()] == [7, 1]
    assert [tuple(r) for r in result.summaries.top_repos.collect()] == [("other", 4), ("proj", 3), ("bin", 1)]
    assert [tuple(r) for r in result.summaries.tiers.collect()] == [("Crest", 1)]
    assert [r.term for r in result.summaries.top_terms.collect()] == ["Iris"]
    table = [r.value for r in spark.read.text(out + "/wordmap_table").collect()]
    assert table[:4] == ["# Word Map", "", "| Term | Tier | Total | Top Example |", "|---|---:|---:|---|"]
    assert table[4] == "| Iris | Crest | 9 | Iris here |"
    assert row_differences(trees.read_hits(spark, out + "/wordmap_raw"), result.hits).count() == 0
    assert [r.value for r in spark.read.text(out + "/visuals").collect()][:5] == [
        "# Visuals (Mermaid)", "", "```mermaid", "pie showData", "  title Bucket Distribution"]


def test_scan_without_hits_writes_no_report(spark, tree, tmp_path):
    out = str(tmp_path / "none")
    spec = ScanSpec(include_paths=[tree], extensions=["md"], anchor_terms=["absent"], output_dir=out)
    result = scan.write_reports(scan.scan(spark, spec), spec)
    assert result.hits.columns == HIT_COLUMNS and result.hits.count() == 0
    assert result.tiers.count() == 0
    assert os.listdir(out) == ["hits.parquet"]
    with pytest.raises(ValueError):
        scan.write_reports(result, ScanSpec())
    with pytest.raises(SpecError):
        scan.scan(spark, ScanSpec())


AWKWARD = [
    ("a,b", "r", "/x/\"q\".md", ".md", "Code", 1, 'say "hi", ok'),
    ("A", "", "/x/line\nbreak", "", "Unknown", 2, ""),
    ("b", "r|s", "/y\\z", ".x", "Planned", 3, "back\\slash \\\" end\\"),
]


@pytest.mark.parametrize("write", [sinks.write_hits_csv, sinks.write_hits_csv_sorted])
def test_csv_round_trip(spark, tmp_path, write):
    schema = "term string, repo string, file string, ext string, bucket string, frequency int, context string"
    hits = spark.createDataFrame(AWKWARD, schema)
    write(hits, str(tmp_path / "csv"))
    back = trees.read_hits(spark, str(tmp_path / "csv"))
    assert back.schema.simpleString() == hits.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(AWKWARD)


def test_csv_header_and_order(spark, tmp_path):
    schema = "term string, repo string, file string, ext string, bucket string, frequency int, context string"
    rows = [("b", "r", "/1", ".x", "Code", 1, "c"), ("a", "s", "/2", ".x", "Code", 1, "c"), ("a", "r", "/3", ".x", "Code", 1, "c")]
    sinks.write_hits_csv_sorted(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "csv"))
    lines = []
    for part in sorted(p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv")):
        with open(tmp_path / "csv" / part, newline="") as handle:
            lines += [row for row in csv.reader(handle)]
    assert lines[0] == ["Term", "Repo", "File", "Ext", "Bucket", "Frequency", "Context"]
    assert [(r[0], r[1]) for r in lines if r[0] != "Term"] == [("a", "r"), ("a", "s"), ("b", "r")]


def test_intermediates_go_to_the_checkpoint_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    kept = sinks.stored(spark.range(3), "numbers")
    assert kept.count() == 3
    assert any(name.startswith("numbers-") for name in os.listdir(folder))


def test_tables_are_spread_only_when_asked(spark, small_dir):
    def plan(query):
        return QUERIES[query](spark, small_dir)._jdf.queryExecution().executedPlan().toString()

    for query in ("term_hits", "path_regex_exclude", "ext_filter", "size_filter"):
        assert "Exchange" not in plan(query)
    spark.conf.set(tables.PARTITIONS_SETTING, "3")
    try:
        assert "Exchange hashpartitioning(path" in plan("term_hits")
        frame = QUERIES["path_regex_exclude"](spark, small_dir)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        exchanged = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", frame._jdf.queryExecution().explainString(mode))
        assert exchanged and not any("text" in columns for columns in exchanged)
    finally:
        spark.conf.unset(tables.PARTITIONS_SETTING)


def test_large_vocabularies_stay_in_generated_code(spark, small_dir):
    for query in ("large_vocabulary_tiers", "benchmark_vocabulary_tiers"):
        plan = QUERIES[query](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_roots_that_differ_in_case_are_both_read(spark, tmp_path):
    for name in ("Docs", "docs/sub"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "a.md").write_text("iris")
    found = trees.walk_tree(spark, [str(tmp_path / "Docs"), str(tmp_path / "docs/sub")])
    assert relative(found.collect(), tmp_path) == ["Docs/a.md", "docs/sub/a.md"]


def test_what_is_left_out_is_reported(spark, tree, monkeypatch):
    spec = ScanSpec(include_paths=[tree, tree + "/nowhere"], extensions=["txt", "md"], anchor_terms=["iris"])
    monkeypatch.setattr(trees, "MAX_VALUE_BYTES", 1_000_000)

    def skipped(spec):
        return {(os.path.relpath(r.path, tree), r.reason) for r in scan.scan(spark, spec).skipped.collect()}

    # Read in pieces, unless a hint can be decided on the whole text only.
    assert skipped(spec) == {("nowhere", trees.MISSING_ROOT)}
    assert scan.scan(spark, spec).hits.where("file like '%big.md'").first().frequency == 300_000
    assert skipped(replace(spec, planned_hints_regex="^plan")) == {("nowhere", trees.MISSING_ROOT), ("big.md", trees.TOO_LONG)}
    nothing = scan.scan(spark, replace(spec, include_paths=["/nowhere/at/all"]))
    assert nothing.hits.count() == 0 and nothing.skipped.count() == 1


def test_a_vanished_file_is_reported_and_another_failure_raises(spark, tree):
    everything = trees.walk_everything(spark, [tree])
    listing = everything.where("path like '%.txt'").drop("skipped")
    os.remove(tree + "/proj/deep/c.txt")
    found = trees.read_or_skipped(listing).where("skipped IS NOT NULL").collect()
    assert [(os.path.relpath(r.path, tree), r.skipped, r.text) for r in found] == [("proj/deep/c.txt", "FileNotFoundError", None)]
    os.mkdir(tree + "/proj/deep/c.txt")  # opening it fails in another way
    with pytest.raises(PythonException):
        trees.read_listed(listing).collect()


def _counting_reader(log):
    """The reader of files, with a line in ``log`` for each file it opens; one of them is gone by then."""
    real = walk._reader

    def build(batch_bytes):
        read = real(batch_bytes)

        def contents(batches):
            for batch in batches:
                with open(log, "a") as out:
                    out.writelines(name + "\n" for name in batch.column(1).to_pylist())
                for name in batch.column(1).to_pylist():
                    if name.endswith("gone.md") and os.path.exists(name):
                        os.remove(name)
                yield from read(iter([batch]))

        return contents

    return build


@pytest.mark.parametrize("search", ["each", "layers"])
def test_hits_and_skipped_files_come_from_one_open_per_file(spark, tree, tmp_path, monkeypatch, search):
    log = str(tmp_path / "opened")
    Path(tree, "proj/gone.md").write_text("iris")
    monkeypatch.setattr(walk, "_reader", _counting_reader(log))
    spec = ScanSpec(
        include_paths=[tree, tree + "/nowhere"], extensions=["txt", "md"], anchor_terms=["iris", "absent", "ir"],
        longest_text_bytes=1_000_000, search=search,
    )
    result = scan.scan(spark, spec)
    skipped = {(os.path.relpath(r.path, tree), r.reason) for r in result.skipped.collect()}
    assert skipped == {("nowhere", trees.MISSING_ROOT), ("big.md", trees.TOO_LONG), ("proj/gone.md", "FileNotFoundError")}
    hits = result.hits.collect()
    assert all(r.frequency > 0 and r.term in ("iris", "ir") for r in hits) and result.hits.columns == HIT_COLUMNS
    assert {r.term for r in result.tiers.collect()} == {"iris", "ir"}
    result.summaries.buckets.collect()
    opened = Path(log).read_text().split()
    assert len(opened) == len(set(opened)) == 11


def test_unreadable_files_raise_without_hidden_names(spark, tree):
    listing = trees.read_tree(spark, [tree], ["txt"])
    os.remove(tree + "/proj/deep/c.txt")
    with pytest.raises(Exception, match="c.txt"):
        listing.collect()


def test_unknown_file_systems_are_named_at_once(spark):
    with pytest.raises(ValueError, match="include_hidden=False"):
        walk.walk(spark, ["viewfs://store/a"])


def test_one_directory_of_many_files(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"{i}.md").write_text("iris")
    spec = ScanSpec(include_paths=[str(tmp_path)], extensions=["md"], anchor_terms=["iris"])
    assert scan.scan(spark, spec).tiers.first().total == 3000


def test_large_directories_are_listed_in_pages(spark, tmp_path, monkeypatch):
    for i in range(500):
        (tmp_path / f"ü{i}.md").write_text("x" * (i % 7))
    for i in range(30):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.md").write_text("iris")
    (tmp_path / "link").symlink_to(tmp_path / "d1")
    whole = sorted(tuple(r) for r in trees.walk_tree(spark, [str(tmp_path)]).collect())
    assert len(whole) == 530
    monkeypatch.setattr(walk, "PAGE_ENTRIES", 40)
    sizes = []
    real = walk.stored

    def kept(table, name):
        out = real(table, name)
        sizes.append([n for n in out.groupBy(F.spark_partition_id()).count().toPandas()["count"]])
        return out

    monkeypatch.setattr(walk, "stored", kept)
    assert sorted(tuple(r) for r in trees.walk_tree(spark, [str(tmp_path)]).collect()) == whole
    assert sizes[0] == [1] and sum(sizes[1]) == 530  # counted first, then listed in pages
    pruned = trees.walk_tree(spark, [str(tmp_path)], "/d[0-9]$")
    assert pruned.count() == 520


def test_small_directories_share_a_batch(tmp_path):
    for i in range(90):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.md").write_text("iris")
    root = str(tmp_path)
    names = [f"{root}/d{i}" for i in range(90)] + [f"{root}/gone"]
    asked = pa.record_batch({"root": [root] * 91, "name": names, "path": names, "page": [0] * 91, "pages": [1] * 91})
    batches = list(walk._lister(40)(iter([asked])))
    assert [b.num_rows for b in batches] == [40, 40, 11]
    assert [r["path"] for b in batches for r in b.to_pylist()] == [f"{n}/a.md" for n in names[:-1]] + [names[-1]]
    assert batches[-1].column("skipped").to_pylist()[-1] == "FileNotFoundError"


def test_texts_as_files_counts_bytes(spark):
    table = spark.createDataFrame([("a", "né")], "p string, t string")
    assert tables.texts_as_files(table, F.col("p"), F.col("t")).first().length == 3


def test_what_is_left_out_is_reported_without_hidden_names(spark, tree, monkeypatch):
    spec = ScanSpec(include_paths=[tree, tree + "/nowhere"], extensions=["txt", "md"], anchor_terms=["iris"], include_hidden=False)
    monkeypatch.setattr(trees, "MAX_VALUE_BYTES", 1_000_000)
    skipped = {(os.path.relpath(r.path, tree), r.reason) for r in scan.scan(spark, spec).skipped.collect()}
    assert skipped == {("nowhere", trees.MISSING_ROOT), ("big.md", trees.TOO_LONG)}
