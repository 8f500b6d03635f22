"""Compare two hit tables.

Every comparison reads each table once: the tables are stacked with a side
mark and reduced by key with partial aggregation.  Nothing is sorted, no row
is paired with another, and equal rows collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_COLUMNS = ["term", "repo", "file", "ext", "bucket", "frequency", "context"]
KEY_COLUMNS = ["term", "file"]
VALUE_COLUMNS = ["repo", "ext", "bucket", "frequency", "context"]
LEFT, RIGHT = "left", "right"

# Fixed value: length of the difference sample.
SAMPLE_ROWS = 30


def _stacked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables with ``weight`` +1 for the left and -1 for the right."""
    sides = [(left, 1), (right, -1)]
    one, other = (df.select(*HIT_COLUMNS, F.lit(weight).alias("weight")) for df, weight in sides)
    return one.unionByName(other)


def _row_hash(columns: Sequence[str]) -> Column:
    """Hash as a decimal, so that sums over any number of rows stay exact."""
    return row_hash(columns).cast("decimal(38,0)")


def row_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """Hash of values and of where nulls stand, which Spark's hash passes over; whole-number types hash alike."""
    values = [F.col(c).cast("bigint") if c == "frequency" else F.col(c) for c in columns]
    return F.xxhash64(F.lit(seed), *values, *[F.isnull(c) for c in columns])


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    return _stacked(left, right).agg(
        F.count_if(F.col("weight") > 0).alias("left_rows"),
        F.count_if(F.col("weight") < 0).alias("right_rows"),
    )


def row_digest(*columns: str) -> Column:
    """60 bits of the MD5 of the columns' texts, the same in every engine.

    Each value goes in with a mark for null and a separator.
    """
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *values).cast("binary")), 1, 15), 16, 10).cast("bigint")


def fingerprint(hits: DataFrame) -> DataFrame:
    """Order-insensitive content hash: row count, xor and sum of row digests.

    Xor alone would cancel pairs of equal rows.
    """
    digest = row_digest(*HIT_COLUMNS)
    return hits.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.bit_xor(digest), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    )


def equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts and whether both tables hold the same rows equally often."""
    balance = F.coalesce(F.sum(F.col("weight") * _row_hash(HIT_COLUMNS)), F.lit(0))
    # The xor of both sides is zero only if each hash occurs an even number of
    # times in total; together with the zero sum this mirrors the fingerprint.
    parity = F.coalesce(F.bit_xor(row_hash(HIT_COLUMNS)), F.lit(0))
    return _stacked(left, right).agg(
        F.count_if(F.col("weight") > 0).alias("left_rows"),
        F.count_if(F.col("weight") < 0).alias("right_rows"),
        ((balance == 0) & (parity == 0)).alias("equal"),
    )


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often: ``side``, ``copies`` and the row.

    The same as subtracting the tables from each other both ways with
    duplicates, with the number of surplus copies as a column.
    """
    return surplus(_stacked(left, right))


def surplus(stacked: DataFrame) -> DataFrame:
    """Rows whose weights, positive for the left side, do not sum to zero."""
    net = stacked.groupBy(*HIT_COLUMNS).agg(F.sum("weight").alias("net"))
    side = F.when(F.col("net") > 0, F.lit(LEFT)).otherwise(F.lit(RIGHT))
    return net.where("net <> 0").select(side.alias("side"), F.abs("net").alias("copies"), *HIT_COLUMNS)


def difference_sample(left: DataFrame, right: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first differences in canonical order."""
    return canonical_order(row_differences(left, right), "side").limit(limit)


def canonical_order(hits: DataFrame, *then: str) -> DataFrame:
    """All seven columns decide; for files meant to be compared as text."""
    return hits.orderBy(*HIT_COLUMNS, *then)


def column_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys (term, file) whose rows differ, and in which columns.

    Frequencies are summed per side, 0 where the key is missing.

    Sums of signed value hashes tell whether a column differs, so a key may
    hold any number of rows on either side.
    """
    weight = F.col("weight")
    net = [F.sum(weight * _row_hash([c])).alias(f"{c}_net") for c in VALUE_COLUMNS]
    by_key = _stacked(left, right).groupBy(*KEY_COLUMNS).agg(
        F.count_if(weight > 0).alias("left_rows"),
        F.count_if(weight < 0).alias("right_rows"),
        F.sum(F.when(weight > 0, F.col("frequency")).otherwise(0)).alias("left_frequency"),
        F.sum(F.when(weight < 0, F.col("frequency")).otherwise(0)).alias("right_frequency"),
        *net,
    )
    differs = [(F.col(f"{c}_net") != 0).alias(f"{c}_differs") for c in VALUE_COLUMNS]
    status = (
        F.when(F.col("right_rows") == 0, F.lit("left_only"))
        .when(F.col("left_rows") == 0, F.lit("right_only"))
        .otherwise(F.lit("changed"))
    )
    changed = F.lit(False)
    for column in VALUE_COLUMNS:
        changed = changed | (F.col(f"{column}_net") != 0)
    return by_key.where((F.col("left_rows") != F.col("right_rows")) | changed).select(
        *KEY_COLUMNS, status.alias("status"), "left_frequency", "right_frequency", *differs
    )
