"""Markdown reports as (line_no, line) tables.

A report has as many lines as there are terms, buckets, tiers or listed
repositories.  Each is computed from one pass over the hits.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termscan.functions.scores import relative_score, rounded_score, score_text, tier_label
from termscan.functions.text import markdown_cell
from termscan.operators.ranking import score_totals, term_profiles
from termscan.operators.summaries import TOP_REPOS, TOP_TERMS
from termscan.spec import DEFAULT_CREST, DEFAULT_SLOPES

# Headings of the reports, one list entry per line.
WORD_MAP_HEAD = ["# Word Map", "", "| Term | Tier | Total | Top Example |", "|---|---:|---:|---|"]
SUMMARY_TITLE = ["# Summary", ""]
SUMMARY_SECTIONS = {
    "bucket": ["## Bucket Distribution", "", "| Bucket | Items |", "|---|---:|"],
    "tier": ["## Tier Distribution (per term)", "", "| Tier | Terms |", "|---|---:|"],
    "repo": ["## Top Repos (by occurrences)", "", "| Repo | Items |", "|---|---:|"],
    "term": ["## Top Terms", "", "| Term | Tier | Total | Score |", "|---|---|---:|---:|"],
}
CHARTS_TITLE = ["# Visuals (Mermaid)", ""]
CHART_TITLES = {"bucket": "Bucket Distribution", "tier": "Tier Distribution (per term)"}
FENCE = "```"

REPO_SALTS = 256
AFTER_BODY = 2**30


def _row(*cells: Column) -> Column:
    parts: list[Column] = [F.lit("| ")]
    for i, cell in enumerate(cells):
        parts += [F.lit(" | ")] * (i > 0) + [cell.cast("string")]
    return F.concat(*parts, F.lit(" |"))


def _numbered(body: DataFrame, fixed: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Number (section, place, line) rows together with fixed lines."""
    constant = json.dumps([{"section": s, "place": p, "line": text} for s, p, text in fixed])
    schema = "array<struct<section:int,place:int,line:string>>"
    one_row = body.sparkSession.range(0, 1, 1, 1)
    lines = one_row.select(F.inline(F.from_json(F.lit(constant), schema)))
    order = Window.partitionBy().orderBy("section", "place")
    everything = body.select("section", "place", "line").unionByName(lines)
    return everything.select(F.row_number().over(order).alias("line_no"), "line").orderBy("line_no")


def word_map_lines(
    hits: DataFrame, crest: float = DEFAULT_CREST, slopes: float = DEFAULT_SLOPES
) -> DataFrame:
    """One row per term by descending total, with tier and best example."""
    ranked = score_totals(term_profiles(hits), crest, slopes)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("total"), "term"))
    body = ranked.select(
        F.lit(1).alias("section"),
        place.alias("place"),
        _row(F.col("term"), F.col("tier"), F.col("total"), markdown_cell(F.coalesce("example", F.lit("")))).alias("line"),
    )
    return _numbered(body, [(0, i, line) for i, line in enumerate(WORD_MAP_HEAD)])


def section_rows(
    hits: DataFrame, crest: float = DEFAULT_CREST, slopes: float = DEFAULT_SLOPES
) -> DataFrame:
    """``section, name, value, tier, score, place`` for all four sections at once.

    Buckets, repositories and terms are grouping sets of one aggregation;
    tiers are counted from the term rows.  ``place`` ranks within a section.
    """
    totals = hits.groupingSets([["bucket"], ["repo"], ["term"]], "bucket", "repo", "term").agg(
        F.grouping("bucket").alias("no_bucket"), F.grouping("repo").alias("no_repo"),
        F.count("*").alias("items"), F.sum("frequency").alias("frequency"),
    )
    is_term = (F.col("no_bucket") == 1) & (F.col("no_repo") == 1)
    named = totals.select(
        F.when(is_term, F.lit("term")).when(F.col("no_repo") == 1, F.lit("bucket")).otherwise(F.lit("repo")).alias("section"),
        F.when(is_term, F.col("term")).when(F.col("no_repo") == 1, F.col("bucket")).otherwise(F.col("repo")).alias("name"),
        F.when(is_term, F.col("frequency")).otherwise(F.col("items")).alias("value"),
    )
    # Terms differing in case only are one term; other names stay as they are.
    key = F.when(F.col("section") == "term", F.lower("name")).otherwise(F.col("name"))
    merged = named.groupBy("section", key.alias("key")).agg(F.min("name").alias("name"), F.sum("value").alias("value"))

    # There can be any number of repositories: they are spread over salted
    # windows and only the best of each salt go on to the ranking.
    salt = F.when(F.col("section") == "repo", F.pmod(F.hash("key"), F.lit(REPO_SALTS))).otherwise(0)
    group = Window.partitionBy("section", salt)
    few = merged.select(
        "section", "name", "value",
        F.max("value").over(group).alias("largest"),
        F.row_number().over(group.orderBy(F.desc("value"), "name")).alias("place"),
    ).where((F.col("section") != "repo") | (F.col("place") <= TOP_REPOS))
    # What is left has at most a few rows per term and salt; in one partition
    # the remaining steps need no shuffle.
    few = few.repartition(1)

    share = F.when(F.col("section") == "term", relative_score(F.col("value"), F.col("largest")))
    labelled = few.withColumn("share", share)
    share = F.col("share")
    labelled = labelled.withColumn("tier", F.when(share.isNotNull(), tier_label(share, crest, slopes)))
    own = F.struct("section", "name", "value", "tier", rounded_score(share).alias("score"))
    no_tier, no_score = F.lit(None).cast("string").alias("tier"), F.lit(None).cast("double").alias("score")
    one_more = F.when(
        F.col("section") == "term",
        F.struct(F.lit("tier").alias("section"), F.col("tier").alias("name"), F.lit(1).cast("bigint").alias("value"), no_tier, no_score),
    )
    rows = labelled.select(F.explode(F.array_compact(F.array(own, one_more))).alias("row")).select("row.*")
    counted = rows.groupBy("section", "name", "tier", "score").agg(F.sum("value").alias("value"))
    best_first = Window.partitionBy("section").orderBy(F.desc("value"), "name")
    return counted.withColumn("place", F.row_number().over(best_first))


def summary_lines(
    hits: DataFrame, crest: float = DEFAULT_CREST, slopes: float = DEFAULT_SLOPES, fixed_scores: bool = False
) -> DataFrame:
    """Bucket and tier distribution, top repositories, top terms."""
    order = {name: i for i, name in enumerate(SUMMARY_SECTIONS, start=1)}
    limit = F.when(F.col("section") == "repo", TOP_REPOS).when(F.col("section") == "term", TOP_TERMS)
    rows = section_rows(hits, crest, slopes).where(limit.isNull() | (F.col("place") <= limit))
    term_row = _row(F.col("name"), F.col("tier"), F.col("value"), score_text(F.col("score"), fixed_scores))
    body = rows.select(
        _section_number(order).alias("section"),
        "place",
        F.when(F.col("section") == "term", term_row).otherwise(_row(F.col("name"), F.col("value"))).alias("line"),
    )
    fixed = [(0, i, line) for i, line in enumerate(SUMMARY_TITLE)]
    for name, number in order.items():
        head = SUMMARY_SECTIONS[name]
        fixed += [(number, i - len(head), line) for i, line in enumerate(head)]
        if number < len(order):
            fixed.append((number, AFTER_BODY, ""))
    return _numbered(body, fixed)


def chart_lines(
    hits: DataFrame, crest: float = DEFAULT_CREST, slopes: float = DEFAULT_SLOPES
) -> DataFrame:
    """Two Mermaid pie charts: hit rows per bucket, terms per tier."""
    order = {name: i for i, name in enumerate(CHART_TITLES, start=1)}
    rows = section_rows(hits, crest, slopes).where(F.col("section").isin(list(order)))
    slice_line = F.concat(F.lit('  "'), "name", F.lit('" : '), F.col("value").cast("string"))
    body = rows.select(_section_number(order).alias("section"), "place", slice_line.alias("line"))
    fixed = [(0, i, line) for i, line in enumerate(CHARTS_TITLE)]
    for name, number in order.items():
        head = [FENCE + "mermaid", "pie showData", "  title " + CHART_TITLES[name]]
        fixed += [(number, i - len(head), line) for i, line in enumerate(head)]
        tail = [FENCE, ""] if number < len(order) else [FENCE]
        fixed += [(number, AFTER_BODY + i, line) for i, line in enumerate(tail)]
    return _numbered(body, fixed)


def _section_number(order: dict[str, int]) -> Column:
    number = F
    for name, i in order.items():
        number = number.when(F.col("section") == name, F.lit(i))
    return number
