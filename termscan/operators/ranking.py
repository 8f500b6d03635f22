"""Totals, tiers and the best example per term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.functions.scores import relative_score, rounded_score, tier_label
from termscan.spec import DEFAULT_CREST, DEFAULT_SLOPES


def _label(hits: DataFrame) -> Column:
    """The spelling a term goes by: the first by ``term_id`` if the hits carry it.

    Hit tables on disk have no ids; among their spellings the smallest is taken.
    """
    return F.min_by("term", F.struct("term_id", "term")) if "term_id" in hits.columns else F.min("term")


def term_totals(hits: DataFrame) -> DataFrame:
    """Summed frequency per term, any case, under one spelling.

    The wide step groups by exact spelling with a hash aggregate; spellings
    are folded together only afterwards, on as many rows as there are
    spellings.
    """
    ids = [F.min("term_id").alias("term_id")] if "term_id" in hits.columns else []
    spelled = hits.groupBy("term").agg(F.sum("frequency").alias("total"), *ids)
    return spelled.groupBy(F.lower("term").alias("term_key")).agg(
        _label(spelled).alias("term"), F.sum("total").alias("total")
    )


def score_totals(totals: DataFrame, crest: float = DEFAULT_CREST, slopes: float = DEFAULT_SLOPES) -> DataFrame:
    """Add score and tier.

    The largest total is a value of its own beside the rows, which stay spread.
    It is taken from whole rows, so both need the same exchange and the hits
    behind it are read once.
    """
    largest = F.max(F.struct("total", *[c for c in totals.columns if c != "total"]))
    shared = totals.withColumn("share", relative_score(F.col("total"), totals.agg(largest.alias("row")).select("row.total").scalar()))
    score, tier = rounded_score(F.col("share")), tier_label(F.col("share"), crest, slopes)
    return shared.withColumns({"score": score, "tier": tier}).drop("share")


def term_tiers(hits: DataFrame, crest: float = DEFAULT_CREST, slopes: float = DEFAULT_SLOPES) -> DataFrame:
    """``term, total, score, tier`` by descending total."""
    ranked = score_totals(term_totals(hits), crest, slopes)
    return ranked.select("term", "total", "score", "tier").orderBy(F.desc("total"), "term")


def term_profiles(hits: DataFrame) -> DataFrame:
    """Total and best example of each term from one pass over the hits.

    The example is the context of the hit with the highest frequency, the
    lowest file name deciding ties.  Both are partial aggregates, so a term
    found in every file sends one row per task.
    """
    best = F.min_by("context", F.struct((-F.col("frequency")).alias("rank"), "file", "context"))
    return hits.groupBy(F.lower("term").alias("term_key")).agg(
        _label(hits).alias("term"), F.sum("frequency").alias("total"), best.alias("example")
    )


def top_examples(hits: DataFrame) -> DataFrame:
    return term_profiles(hits).select("term", "example")
