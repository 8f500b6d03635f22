"""Rules and roots as tables give what the lists give."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from termscan.functions import paths
from termscan.functions.patterns import glob_regex, ignore_case, parse_rules
from termscan.operators import filters, path_tables

NAMES = ["a", "B", "src", "bin", "İx", "straße", "K", "dotted.d", "x y", "[z]", "é", "long.tar"]
ENDS = [".md", ".MD", ".py", ".t+t", "", ".", ".gz"]


def random_paths(rng, n):
    return [rng.choice(["/", "", "c:\\"]) + rng.choice(["/", "\\", "//"]).join(rng.choices(NAMES, k=rng.randint(1, 4))) + rng.choice(ENDS) for _ in range(n)]


def random_rule(rng, known):
    kind = rng.random()
    if kind < 0.1:
        return rng.choice(["", "  ", "# note", "!", "! # odd", "!  **/bin/** "])
    segments = rng.choice(known).replace("\\", "/").split("/")
    for i in range(len(segments)):
        if rng.random() < 0.3:
            segments[i] = rng.choice(["*", "**", "?", "b*", "*.md", "*" + segments[i][1:], segments[i].upper()])
    return ("!" if rng.random() < 0.4 else "") + rng.choice(["", "**/", "**"]) + "/".join(segments) + rng.choice(["", "", "/**", "*"])


def kept_by_loop(every, lines):
    """Each path against each rule, one after the other."""
    rules = [(re.compile("(?i)^(?:" + glob_regex(glob) + ")$"), negated) for glob, negated in parse_rules(lines)]
    out = []
    for path in every:
        verdict = False
        for pattern, negated in rules:
            if pattern.search(path.replace("\\", "/")):
                verdict = not negated
        if not verdict:
            out.append(path)
    return sorted(out)


def rule_rows(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "rule_no long, line string")


def test_ten_thousand_rules_equal_the_plain_loop(spark):
    rng = random.Random(5)
    every = [p for p in random_paths(rng, 300) if p.isascii()]
    lines = [random_rule(rng, every) for _ in range(10_000)]
    files = spark.createDataFrame([(p,) for p in every], "path string")
    got = sorted(r.path for r in path_tables.apply_rule_table(files, rule_rows(spark, lines)).collect())
    want = kept_by_loop(every, lines)
    assert got == want and 0 < len(want) < len(every)


def test_a_table_of_rules_equals_a_list(spark):
    rng = random.Random(11)
    every = random_paths(rng, 250)
    files = spark.createDataFrame([(p, i) for i, p in enumerate(every)] + [(None, -1)], "path string, n int")
    for _ in range(4):
        lines = [random_rule(rng, every) for _ in range(12)]
        listed = sorted(map(str, filters.apply_rules(files.where("path IS NOT NULL"), lines).collect()))
        got = path_tables.apply_rule_table(files, rule_rows(spark, lines))
        assert got.columns == ["path", "n"]
        rows = got.collect()
        assert sorted(str(r) for r in rows if r.path is not None) == listed
        assert sum(r.path is None for r in rows) == 1


def test_patterns_are_those_of_the_driver(spark):
    globs = ["**/a.b/*", "a?c[1]{2}", "***", "x|y", "$^\\", "(a)+", "**"]
    frame = spark.createDataFrame([(g,) for g in globs], "glob string").select("glob", path_tables.glob_pattern(F.col("glob")).alias("p"))
    assert {r.glob: r.p for r in frame.collect()} == {g: ignore_case(f"^(?:{glob_regex(g)})$") for g in globs}


def test_empty_tables(spark):
    files = spark.createDataFrame([("/a/b",)], "path string")
    nothing = files.where("false")
    assert path_tables.apply_rule_table(files, rule_rows(spark, ["# none", ""])).count() == 1
    assert path_tables.apply_rule_table(nothing, rule_rows(spark, ["**"])).count() == 0
    roots = spark.createDataFrame([], "root_id long, root string")
    assert [tuple(r) for r in path_tables.with_repo(files, roots).collect()] == [("/a/b", None, None, "b")]
    assert path_tables.first_roots(nothing, roots).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_a_table_of_roots_equals_a_list(spark, seed):
    rng = random.Random(seed)
    every = random_paths(rng, 250) + ["/", "", "/ /x", "a/ /b", "/a/", "/a//B"]
    roots = [rng.choice(every).rsplit("/", 1)[0] + rng.choice(["", "/", "\\"]) for _ in range(25)] + ["/A", "/"]
    files = spark.createDataFrame([(p, 1) for p in dict.fromkeys(every)], "path string, n int")
    table = spark.createDataFrame(list(enumerate(roots)), "root_id long, root string")
    path = F.col("path")
    want = files.select("path", "n", paths.first_root(path, roots).alias("root"), paths.repo_name(path, roots).alias("repo"))
    got = path_tables.with_repo(files, table).select("path", "n", "root", "repo")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ten_thousand_roots(spark):
    files = spark.range(30_000).selectExpr("concat('/top/d', id % 12000, '/repo', id % 7, '/f', id) AS path")
    roots = spark.range(10_000).selectExpr("id AS root_id", "concat('/TOP/d', id, '/') AS root").unionByName(
        spark.createDataFrame([(20_000, "/top")], "root_id long, root string"))
    counts = path_tables.with_repo(files, roots).groupBy("root_id").count().toPandas().set_index("root_id")["count"]
    assert len(counts) == 10_001 and counts.sum() == 30_000
    assert counts[20_000] == sum(1 for i in range(30_000) if i % 12_000 >= 10_000)
