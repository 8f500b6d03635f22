"""Path filters, ignore rules, buckets and repository names."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termscan.functions import paths
from termscan.functions.patterns import glob_regex, literal_alternatives, parse_rules, rule_runs, usable_pattern
from termscan.operators import classify, dedupe, filters
from termscan.plans.scan import file_buckets, hit_rows, scan_files
from termscan.spec import ScanSpec, SpecError


def kept(files):
    return sorted(r.path for r in files.select("path").collect())


def paths_only(files_of, *names):
    return files_of(*[(name, "t") for name in names])


@pytest.mark.parametrize("pattern", ["*.md", ".md", "md", " *.MD "])
def test_extension_forms(files_of, pattern):
    files = paths_only(files_of, "/a/X.MD", "/a/y.mdx", "/a.md/z", "/a/end.")
    assert kept(filters.keep_extensions(files, [pattern])) == ["/a/X.MD"]


@pytest.mark.parametrize("path,expected", [
    ("/a/b.TXT", ".txt"), ("/a.b/c", ""), ("/a/.profile", ".profile"), ("C:\\x\\y.Py", ".py"), ("/a/b.", ""),
])
def test_extension(spark, path, expected):
    assert spark.range(1).select(paths.extension(F.lit(path))).first()[0] == expected


@pytest.mark.parametrize("lines,path,excluded", [
    (["**/bin/**", "!**/keep.md"], "/x/bin/keep.md", False),
    (["!**/keep.md", "**/bin/**"], "/x/bin/keep.md", True),
    (["/a/*.md"], "/a/b/c.md", False),
    (["/a/**.md"], "/a/b/c.md", True),
    (["*.log"], "/a/b.log", False),
    (["**/a?c"], "/x/abc", True),
    (["**/a?c"], "/x/a/c", False),
    (["**/~WR[DL]*.tmp"], "/x/~WRD1.tmp", False),
    (["**/~WR[DL]*.tmp"], "/x/~wr[dl]9.TMP", True),
    (["**/BIN/**"], "C:\\x\\bin\\y", True),
    (["# **", "", "   "], "/x", False),
    ([], "/x", False),
])
def test_ignore_rules(files_of, lines, path, excluded):
    assert kept(filters.apply_rules(paths_only(files_of, path), lines)) == ([] if excluded else [path])


def last_match(lines, path):
    state = False
    for glob, negated in parse_rules(lines):
        if re.fullmatch(glob_regex(glob), path, re.IGNORECASE):
            state = not negated
    return state


segments = st.sampled_from(["a", "b", "bin", "x.md", "K.MD"])
globs = st.builds(
    lambda bang, parts: ("!" if bang else "") + "/".join(parts),
    st.booleans(), st.lists(st.sampled_from(["**", "*", "a", "b*", "?in", "*.md", ""]), min_size=1, max_size=4))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(globs, max_size=6), names=st.lists(st.lists(segments, min_size=1, max_size=4), min_size=1, max_size=5))
def test_merged_rules_agree_with_a_plain_loop(files_of, lines, names):
    every = sorted({"/" + "/".join(n) for n in names})
    expected = [p for p in every if not last_match(lines, p)]
    assert kept(filters.apply_rules(paths_only(files_of, *every), lines)) == expected


def test_neighbouring_rules_share_one_pattern():
    assert len(rule_runs(["a", "b", "!c", "d", "e"])) == 3


def test_regex_excludes_ignore_case_and_blank_means_none(files_of):
    files = paths_only(files_of, "/x/BIN/a", "/x/binary", "/y")
    assert kept(filters.exclude_paths(files, r"/bin(/|$)")) == ["/x/binary", "/y"]
    assert kept(filters.exclude_paths(files, " ")) == ["/x/BIN/a", "/x/binary", "/y"]
    assert kept(filters.exclude_files(files, None)) == ["/x/BIN/a", "/x/binary", "/y"]


def test_pruning_tests_directories_below_the_root_only(files_of):
    files = paths_only(files_of, "/bin/r/a.md", "/bin/r/BIN/b.md", "/bin/r/x/bin/c/d.md", "/bin/r/bin", "e.md")
    rule = "/bin$"
    assert kept(filters.prune_directories(files, rule, ["/bin/r/"])) == ["/bin/r/a.md", "/bin/r/bin", "e.md"]
    assert kept(filters.prune_directories(files, rule)) == ["e.md"]


def test_pruning_keeps_the_separators_of_the_path(files_of):
    files = paths_only(files_of, "C:\\r\\bin\\a", "C:\\r\\b\\a")
    assert kept(filters.prune_directories(files, r"\\bin$", ["C:\\r"])) == ["C:\\r\\b\\a"]


def test_size_limit_is_inclusive(files_of):
    exact, more = "x" * 100, "x" * 101
    files = files_of(("/a", exact), ("/b", more), ("/c", "é" * 51))
    assert kept(filters.max_bytes(files, 100)) == ["/a"]
    assert kept(filters.max_bytes(files, 0)) == ["/a", "/b", "/c"]
    assert kept(filters.max_megabytes(files.withColumn("length", F.lit(2 * 1024 * 1024)), 2)) == ["/a", "/b", "/c"]
    assert kept(filters.max_megabytes(files.withColumn("length", F.lit(2 * 1024 * 1024 + 1)), 2)) == []


def test_output_directory_and_generated_files(files_of):
    files = paths_only(files_of, "/Out/a.md", "/outer/b.md", "/x/Summary.MD", "/x/wordmap_raw.csv", "/x/c.md")
    left = ["/outer/b.md", "/x/Summary.MD", "/x/c.md", "/x/wordmap_raw.csv"]
    assert kept(filters.skip_output_directory(files, "/out/")) == left
    assert kept(filters.skip_output_directory(files, None, " ", "/out", "/X")) == left[:1]
    assert kept(filters.skip_output_directory(paths_only(files_of, "C:\\o\\a", "C:\\o2\\a"), "c:\\O\\")) == ["C:\\o2\\a"]
    assert kept(filters.skip_generated(files)) == ["/Out/a.md", "/outer/b.md", "/x/c.md"]


@pytest.mark.parametrize("planned,code,text,expected", [
    ("plan|todo", "def|class", "PLANE with a Class", "Overlap"),
    ("plan|todo", "def|class", "a plan", "Planned"),
    ("plan|todo", "def|class", "undefined", "Code"),
    ("plan|todo", "def|class", "neither", "Unknown"),
    ("", None, "anything", "Unknown"),
    ("(?i)pl[ae]n", "x+y", "PLEN xxy", "Overlap"),
    ("[broken", "def", "def [broken", "Code"),
    ("über", "k", "ÜBER \u212a", "Overlap"),
])
def test_buckets(files_of, planned, code, text, expected):
    spec = ScanSpec(planned_hints_regex=planned, code_hints_regex=code)
    assert file_buckets(files_of(("/f", text)), spec).first().bucket == expected


def test_empty_texts_are_skipped(files_of):
    files = files_of(("/a", ""), ("/b", "x"), ("/c", None))
    assert kept(file_buckets(files, ScanSpec())) == ["/b"]
    assert [r.file for r in hit_rows(files, ScanSpec(anchor_terms=["x"])).collect()] == ["/b"]


@pytest.mark.parametrize("pattern,words", [
    ("(?i)plan|#include|a b", ["plan", "#include", "a b"]), ("plan|", None), ("a.b", None), ("(a|b)", None), ("x", ["x"]),
])
def test_literal_alternatives(pattern, words):
    assert literal_alternatives(pattern) == words


def test_usable_pattern(spark):
    assert usable_pattern(spark, "a(b") is None
    assert usable_pattern(spark, "  ") is None
    assert usable_pattern(spark, "a|b") == "a|b"


def test_hint_alphabet_covers_literal_words_only():
    assert classify.hint_alphabet("Ab|c", "x.y", None) == {"a", "b", "c"}


@pytest.mark.parametrize("path,roots,repo", [
    ("/r/top.md", ["/r/"], "top.md"),
    ("/r/a/x/y.md", ["/r/a/", "/r/"], "x"),
    ("/r/a/x/y.md", ["/r/", "/r/a/"], "a"),
    ("/R/A/x.md", ["/r"], "A"),
    ("/ab/x/y.md", ["/a"], "x"),
    ("C:\\A\\B\\f", ["D:\\"], "B"),
    ("C:\\Git\\Proj\\f.md", ["c:\\git\\"], "Proj"),
    ("a/b", [], "b"),
    ("alone", [], "alone"),
    ("/r/ /x.md", ["/r/"], "(root)"),
    ("/r//a/x.md", ["/r/"], "a"),
    ("/r.x/a/b", ["/r?x"], "a"),
])
def test_repo_name(spark, path, roots, repo):
    assert spark.range(1).select(paths.repo_name(F.lit(path), roots)).first()[0] == repo


def test_first_root(spark):
    roots = ["/c/src1/", "/C/", "/c/src2/"]
    table = spark.createDataFrame([("/c/src1/a",), ("/c/src10/a",), ("/c/src2/a",), ("/d/a",), ("/c/",)], "p string")
    got = [r[0] for r in table.select(paths.first_root(F.col("p"), roots)).collect()]
    assert got == ["/c/src1/", "/C/", "/C/", None, None]


def test_overlapping_roots(files_of):
    files = paths_only(files_of, "/r/a/x", "/r/y", "/z")
    every = dedupe.files_per_root(files, ["/r/", "/r/a/"])
    assert sorted((r.path, r.root_id) for r in every.collect()) == [("/r/a/x", 0), ("/r/a/x", 1), ("/r/y", 0)]
    once = dedupe.distinct_files(every, ["root_id", "path"])
    assert sorted((r.path, r.root_id) for r in once.collect()) == [("/r/a/x", 0), ("/r/y", 0)]
    again = dedupe.distinct_files(once, ["root_id", "path"])
    assert sorted(again.collect()) == sorted(once.collect())


def test_distinct_files_by_path_in_any_case(files_of):
    files = files_of(("/a/X.md", "1"), ("/a/x.md", "2"), ("/b", "3"), ("/b", "3"), ("/b", "2"))
    assert kept(dedupe.distinct_files(files)) == ["/a/X.md", "/b"]
    assert {r.path: r.text for r in dedupe.distinct_files(files).collect()}["/b"] == "2"


def test_copies_of_a_file_count_once(files_of):
    spec = ScanSpec(include_paths=["/r/"], extensions=["md"], anchor_terms=["iris", "b"])
    exact = files_of(("/r/a.md", "iris iris b"), ("/r/a.md", "iris iris b"), ("/r/b.md", "iris"))
    assert {r.term: r.total for r in scan_files(exact, spec).tiers.collect()} == {"iris": 3, "b": 1}
    assert scan_files(exact, replace(spec, dedupe=False)).hits.count() == 5
    differing = files_of(("/r/a.md", "iris iris b"), ("/r/A.md", "iris"), ("/r/a.md", "b b"), ("/r/c.md", "b"), ("/r/c.md", "none"))
    rows = scan_files(differing, spec).hits.collect()
    assert [(r.file, r.frequency) for r in rows if r.file != "/r/c.md"] == [("/r/A.md", 1)]
    assert len([r for r in rows if r.file == "/r/c.md"]) <= 1


def test_removing_copies_exchanges_no_text(files_of):
    hits = scan_files(files_of(("/r/a.md", "iris")), ScanSpec(extensions=["md"], anchor_terms=["iris"])).hits
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Python" not in plan
    formatted = hits._jdf.queryExecution().explainString(hits.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    assert exchanges and not any(re.search(r"\b(text|folded_text)#", columns) for columns in exchanges)


def test_distinct_roots():
    assert dedupe.distinct_roots(["/r/a/", "/r/", "/R", "/rb", "/r/a/b", "/r"]) == ["/r/", "/R", "/rb"]


def test_expand_env(monkeypatch):
    monkeypatch.setenv("SCAN_HOME", "/home/x")
    assert paths.expand_env("%SCAN_HOME%/a") == "/home/x/a"
    assert paths.expand_env("$($env:SCAN_HOME)/a") == "/home/x/a"
    assert paths.expand_env("$env:SCAN_HOME/a") == "/home/x/a"
    assert paths.expand_env("%NOT_SET_HERE%/a") == "%NOT_SET_HERE%/a"


def test_spec_normalisation_and_validation(spark):
    spec = ScanSpec.from_mapping({
        "include_paths": ["/r", " "], "extensions": ["*.MD", "md", "txt"], "anchor_terms": ["A", ""],
        "exclude_dir_regex": "  ", "crest_threshold": 0, "slopes_threshold": -1, "max_file_mb": -3, "unknown": 1,
    })
    assert (spec.include_paths, spec.extensions, spec.anchor_terms) == (["/r"], [".md", ".txt"], ["A"])
    assert (spec.exclude_dir_regex, spec.crest_threshold, spec.slopes_threshold, spec.max_file_mb) == (None, 0.9, 0.6, 0)
    assert spec.validate(spark) is spec
    good = {"include_paths": ["/r"], "extensions": ["md"], "anchor_terms": ["a"]}
    for broken in ({"include_paths": []}, {"extensions": []}, {"anchor_terms": [" "]}, {"crest_threshold": 1.5},
                   {"slopes_threshold": 0.95}, {"code_hints_regex": "("}):
        with pytest.raises(SpecError):
            ScanSpec.from_mapping({**good, **broken}).validate(spark)
