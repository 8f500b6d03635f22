"""Score, tier label and number format of ranked terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CREST, SLOPES, BASE = "Crest", "Slopes", "Base"


def relative_score(total: Column, largest: Column) -> Column:
    return F.when(largest > 0, total.cast("double") / largest).otherwise(F.lit(0.0))


def tier_label(score: Column, crest: float, slopes: float) -> Column:
    """Tier of an unrounded score."""
    return (
        F.when(score >= crest, F.lit(CREST))
        .when(score >= slopes, F.lit(SLOPES))
        .otherwise(F.lit(BASE))
    )


def rounded_score(score: Column) -> Column:
    """Three places, halves to even."""
    return F.bround(score, 3)


def score_text(score: Column, fixed: bool = False) -> Column:
    """At most three places without trailing zeros, or always three."""
    if fixed:
        return F.format_string("%.3f", score)
    return F.call_function("format_number", score, F.lit("0.###"))
