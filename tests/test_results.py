"""Tiers, summaries, reports and reconciliation on hand-made hit tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termscan.operators import ranking, reconcile, reports, summaries
from termscan.plans import scan
from termscan.sources import sinks
from termscan.spec import ScanSpec

HITS = "term string, repo string, file string, ext string, bucket string, frequency int, context string"

# Totals of a published run with scores and tiers at 0.90 / 0.60.
PUBLISHED = [
    (1940, 1.0, "Crest"), (1643, 0.847, "Slopes"), (1191, 0.614, "Slopes"), (773, 0.398, "Base"),
    (713, 0.368, "Base"), (663, 0.342, "Base"), (520, 0.268, "Base"), (454, 0.234, "Base"), (401, 0.207, "Base"),
    (329, 0.17, "Base"), (323, 0.166, "Base"), (323, 0.166, "Base"), (245, 0.126, "Base"), (241, 0.124, "Base"),
    (114, 0.059, "Base"),
]


def hit(term="t", repo="r", file="/f", bucket="Code", frequency=1, context="c"):
    return (term, repo, file, ".md", bucket, frequency, context)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), HITS)


def test_published_tiers(table):
    rows = [hit(f"term{i:02}", frequency=total) for i, (total, _, _) in enumerate(PUBLISHED)]
    got = [(r.total, r.score, r.tier) for r in ranking.term_tiers(table(*rows)).collect()]
    assert got == PUBLISHED


def test_tiers_use_the_unrounded_score_and_round_half_even(table):
    rows = [hit("max", frequency=10000), hit("near", frequency=8996), hit("half", frequency=625)]
    got = {r.term: (r.score, r.tier) for r in ranking.term_tiers(table(*rows)).collect()}
    assert got == {"max": (1.0, "Crest"), "near": (0.9, "Slopes"), "half": (0.062, "Base")}


def test_terms_are_grouped_in_any_case(table):
    rows = [hit("Ab", frequency=1, context="x"), hit("aB", file="/g", frequency=3, context="y"), hit("z", frequency=2)]
    assert [(r.term, r.total) for r in ranking.term_tiers(table(*rows)).collect()] == [("Ab", 4), ("z", 2)]
    assert {r.term: r.example for r in ranking.top_examples(table(*rows)).collect()} == {"Ab": "y", "z": "c"}


def test_zero_totals_score_zero(table):
    assert [tuple(r) for r in ranking.term_tiers(table(hit(frequency=0))).collect()] == [("t", 0, 0.0, "Base")]


def test_top_lists_and_distributions(table):
    rows = [hit(repo=f"r{i % 12:02}", file=f"/{i}", bucket=("Code" if i % 3 else "Planned"), frequency=i) for i in range(40)]
    hits = table(*rows)
    top = [(r.repo, r["items"]) for r in summaries.top_repos(hits).collect()]
    assert top == [(f"r{i:02}", 4 if i < 4 else 3) for i in range(10)]
    assert [tuple(r) for r in summaries.bucket_distribution(hits).collect()] == [("Code", 26), ("Planned", 14)]
    tiers = ranking.term_tiers(hits)
    assert [tuple(r) for r in summaries.tier_distribution(tiers).collect()] == [("Crest", 1)]
    assert summaries.top_terms(tiers).count() == 1
    files = hits.select(F.col("file").alias("path"), F.col("frequency").cast("bigint").alias("length"))
    assert [r.length for r in summaries.largest_files(files).collect()] == list(range(39, 29, -1))
    assert tuple(summaries.scan_counts(files, hits).first()) == (40, 40, 40)


def test_groups_in_any_case(spark):
    hits = spark.createDataFrame([("Repo", "Code"), ("repo", "code"), ("x", "CODE"), ("x", "Code")], "repo string, bucket string")
    assert [tuple(r) for r in summaries.bucket_distribution(hits, any_case=True).collect()] == [("CODE", 4)]
    assert [tuple(r) for r in summaries.top_repos(hits, any_case=True).collect()] == [("Repo", 2), ("x", 2)]
    assert summaries.top_repos(hits).count() == 3


def test_word_map_escapes_pipes(table):
    lines = [r.line for r in reports.word_map_lines(table(hit("a|b", context="x|y"))).collect()]
    assert lines[4:] == ["| a|b | Crest | 1 | x\\|y |"]


def test_summary_report(table):
    rows = [hit("big", "r1", "/1", "Code", 10), hit("mid", "r1", "/1", "Code", 7), hit("low", "r2", "/2", "Unknown", 1)]
    lines = [r.line for r in reports.summary_lines(table(*rows)).orderBy("line_no").collect()]
    assert lines == [
        "# Summary", "",
        "## Bucket Distribution", "", "| Bucket | Items |", "|---|---:|", "| Code | 2 |", "| Unknown | 1 |", "",
        "## Tier Distribution (per term)", "", "| Tier | Terms |", "|---|---:|",
        "| Base | 1 |", "| Crest | 1 |", "| Slopes | 1 |", "",
        "## Top Repos (by occurrences)", "", "| Repo | Items |", "|---|---:|", "| r1 | 2 |", "| r2 | 1 |", "",
        "## Top Terms", "", "| Term | Tier | Total | Score |", "|---|---|---:|---:|",
        "| big | Crest | 10 | 1 |", "| mid | Slopes | 7 | 0.7 |", "| low | Base | 1 | 0.1 |",
    ]


def test_scores_with_three_places(table):
    lines = [r.line for r in reports.summary_lines(table(hit(), hit("u", frequency=2)), fixed_scores=True).collect()]
    assert lines[-2:] == ["| u | Crest | 2 | 1.000 |", "| t | Base | 1 | 0.500 |"]


def test_summaries_are_printed(table, capsys):
    scan.show_summaries(scan.result_of(table(hit()), ScanSpec()))
    printed = capsys.readouterr().out
    assert all(word in printed for word in ("Buckets", "Tiers", "Top Repos", "Top Terms", "Code"))


def test_summary_with_more_repositories_than_salts(table, monkeypatch):
    monkeypatch.setattr(reports, "REPO_SALTS", 2)
    rows = [hit(repo=f"r{i:02}", file=f"/{i}/{j}") for i in range(30) for j in range(i)]
    lines = [r.line for r in reports.summary_lines(table(*rows)).collect() if r.line.startswith("| r")]
    assert lines == [f"| r{i:02} | {i} |" for i in range(29, 19, -1)]


def test_chart_report(table):
    lines = [r.line for r in reports.chart_lines(table(hit("a", bucket="Code"), hit("b", bucket="Overlap", frequency=9))).collect()]
    assert lines == [
        "# Visuals (Mermaid)", "", "```mermaid", "pie showData", "  title Bucket Distribution",
        '  "Code" : 1', '  "Overlap" : 1', "```", "", "```mermaid", "pie showData",
        "  title Tier Distribution (per term)", '  "Base" : 1', '  "Crest" : 1', "```",
    ]


BASE = [hit("a", file="/1"), hit("b", file="/1"), hit("c", file="/2"), hit("c", file="/2")]


@pytest.mark.parametrize("other,equal,differences", [
    (BASE[::-1], True, []),
    (BASE[1:], False, [("left", 1, "a")]),
    (BASE + [hit("d")], False, [("right", 1, "d")]),
    (BASE[:3], False, [("left", 1, "c")]),
    (BASE[:2] + [BASE[0], BASE[0]], False, [("left", 2, "c"), ("right", 2, "a")]),
    ([hit("a", file="/1", frequency=5)] + BASE[1:], False, [("left", 1, "a"), ("right", 1, "a")]),
    (BASE + [hit("e"), hit("e")], False, [("right", 2, "e")]),
])
def test_reconciliation(table, other, equal, differences):
    left, right = table(*BASE), table(*other)
    counts = reconcile.row_counts(left, right).first()
    assert tuple(counts) == (len(BASE), len(other))
    assert tuple(reconcile.equality(left, right).first()) == (len(BASE), len(other), equal)
    got = sorted((r.side, r.copies, r.term) for r in reconcile.row_differences(left, right).collect())
    assert got == sorted(differences)
    prints = [reconcile.fingerprint(t).first() for t in (left, right)]
    assert (prints[0] == prints[1]) == equal


def test_empty_tables_are_equal(table):
    empty = table(hit()).limit(0)
    assert tuple(reconcile.equality(empty, empty).first()) == (0, 0, True)
    assert tuple(reconcile.fingerprint(empty).first()) == (0, 0, 0)


def test_difference_sample_is_bounded_and_ordered(table):
    rows = [hit(f"t{i:03}") for i in range(50)]
    sample = reconcile.difference_sample(table(*rows), table(hit("z"))).collect()
    assert [r.term for r in sample] == [f"t{i:03}" for i in range(30)]


def test_column_differences(table):
    left = table(hit("a", file="/1"), hit("b", file="/1", frequency=2), hit("c", file="/1"), hit("e"), hit("e"))
    right = table(hit("a", file="/1"), hit("b", file="/1", frequency=3, context="x"), hit("d", file="/1"), hit("e"), hit("e", context="y"))
    got = {r.term: (r.status, r.left_frequency, r.right_frequency, r.frequency_differs, r.context_differs, r.bucket_differs)
           for r in reconcile.column_differences(left, right).collect()}
    assert got == {
        "b": ("changed", 2, 3, True, True, False),
        "c": ("left_only", 1, 0, True, True, True),
        "d": ("right_only", 0, 1, True, True, True),
        "e": ("changed", 2, 2, False, True, False),
    }


def test_the_largest_total_needs_no_window_and_no_second_reading(spark, tmp_path):
    hits = spark.range(3000).selectExpr(
        "concat('t', id % 500) AS term", "cast(id AS string) AS file", "cast(id % 7 AS int) AS frequency", "'c' AS context"
    )
    stored = sinks.write_hits(hits, str(tmp_path / "hits"))
    ranked = ranking.score_totals(ranking.term_profiles(stored))
    rows = ranked.collect()
    most = max(r.total for r in rows)
    assert len(rows) == 500 and all(r.score == round(r.total / most, 3) for r in rows if r.total in (0, most))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ReusedExchange" in plan
