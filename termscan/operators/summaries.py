"""Distributions and top lists over hits and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lengths of the top lists.
TOP_REPOS = 10
TOP_TERMS = 15
LARGEST_FILES = 10


def _counted(hits: DataFrame, column: str, any_case: bool) -> DataFrame:
    """Hit rows per value; with ``any_case`` values that differ in case only are one, the smallest naming it.

    Exact values are counted first, so the folding sees few rows.
    """
    counts = hits.groupBy(column).agg(F.count("*").alias("items"))
    if not any_case:
        return counts
    return counts.groupBy(F.lower(column).alias("_key")).agg(F.min(column).alias(column), F.sum("items").alias("items")).drop("_key")


def bucket_distribution(hits: DataFrame, any_case: bool = False) -> DataFrame:
    """Hit rows per bucket."""
    return _counted(hits, "bucket", any_case).orderBy(F.desc("items"), "bucket")


def tier_distribution(tiers: DataFrame) -> DataFrame:
    """Terms per tier."""
    return tiers.groupBy("tier").agg(F.count("*").alias("terms")).orderBy(F.desc("terms"), "tier")


def repo_counts(hits: DataFrame, any_case: bool = False) -> DataFrame:
    """Hit rows (not summed frequencies) per repository."""
    return _counted(hits, "repo", any_case)


def top_repos(hits: DataFrame, limit: int = TOP_REPOS, any_case: bool = False) -> DataFrame:
    return repo_counts(hits, any_case).orderBy(F.desc("items"), "repo").limit(limit)


def top_terms(tiers: DataFrame, limit: int = TOP_TERMS) -> DataFrame:
    return tiers.orderBy(F.desc("total"), "term").limit(limit)


def largest_files(files: DataFrame, limit: int = LARGEST_FILES) -> DataFrame:
    """Needs paths and lengths only; no content is read."""
    return files.select("path", "length").orderBy(F.desc("length"), "path").limit(limit)


def scan_counts(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of files, of hit rows, and of files with a hit."""
    counted = files.agg(F.count("*").alias("files"))
    hit_counts = hits.agg(
        F.count("*").alias("hit_rows"), F.count_distinct("file").alias("files_with_hits")
    )
    return hit_counts.withColumn("files", counted.scalar()).select("files", "hit_rows", "files_with_hits")
