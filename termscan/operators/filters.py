"""Which files are scanned.  All filters are path or length predicates.

They need no file content, so Catalyst evaluates them before any text
expression, and the length limit reaches the file source itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.functions import paths
from termscan.functions.patterns import escape, ignore_case, is_blank, rule_runs

MEGABYTE = 1024 * 1024

# Names of report files that an earlier scan may have left behind.
GENERATED_NAMES = ["SUMMARY.md", "WORDMAP_RAW.csv", "WORDMAP_TABLE.md"]


def keep_extensions(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return files.where(paths.extension(F.col("path")).isin(paths.normalize_extensions(patterns)))


def exclude_paths(files: DataFrame, regex: str | None) -> DataFrame:
    """Drop files whose full path contains a match; a blank regex drops none."""
    if is_blank(regex):
        return files
    return files.where(~F.rlike("path", F.lit(ignore_case(regex))))


# The file rule searches the full path as well; only its intent differs.
exclude_files = exclude_paths


def prune_directories(files: DataFrame, regex: str | None, roots: Sequence[str] = ()) -> DataFrame:
    """Drop everything below a directory whose own path contains a match.

    Each ancestor directory, from the include root down, is tested by its full
    path, so a pattern anchored at the end prunes the whole subtree.  Storing a
    corpus partitioned by top directory turns the same rule into partition
    pruning.
    """
    if is_blank(regex):
        return files
    path = F.col("path")
    parts = F.split(paths.slashes(path), "/")
    shortest = F.coalesce(F.length(F.rtrim(paths.slashes(paths.first_root(path, roots)), F.lit("/"))), F.lit(1))

    def matches(depth: Column) -> Column:
        size = F.length(F.array_join(F.slice(parts, F.lit(1), depth), "/"))
        return (size >= shortest) & F.rlike(F.substring(path, F.lit(1), size), F.lit(ignore_case(regex)))

    # A path without separator has no ancestors to test.
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    return files.where(~F.coalesce(F.exists(depths, matches), F.lit(False)))


def excluded_by_rules(path: Column, lines: Iterable[str]) -> Column:
    """Verdict of ordered ignore rules: the last matching rule wins."""
    normal = paths.slashes(path)
    verdict = F
    for regex, negated in reversed(rule_runs(lines)):
        verdict = verdict.when(F.rlike(normal, F.lit(regex)), F.lit(not negated))
    return F.lit(False) if verdict is F else verdict.otherwise(F.lit(False))


def apply_rules(files: DataFrame, lines: Iterable[str]) -> DataFrame:
    return files.where(~excluded_by_rules(F.col("path"), lines))


def max_bytes(files: DataFrame, limit: int) -> DataFrame:
    """Keep files of at most ``limit`` bytes; 0 means no limit."""
    return files.where(F.col("length") <= F.lit(limit).cast("bigint")) if limit > 0 else files


def max_megabytes(files: DataFrame, limit: int) -> DataFrame:
    return max_bytes(files, limit * MEGABYTE)


def skip_output_directory(files: DataFrame, *directories: str | None) -> DataFrame:
    """Do not scan earlier results: drop what lies in one of the directories, any case.

    A directory ends at a separator: ``/c/out`` leaves ``/c/out2`` alone.
    """
    for directory in directories:
        if not is_blank(directory):
            inside = f"^{escape(directory.rstrip('/' + chr(92)))}([/\\\\]|$)"
            files = files.where(~F.rlike("path", F.lit(ignore_case(inside))))
    return files


def skip_generated(files: DataFrame) -> DataFrame:
    return files.where(~F.lower(paths.base_name(F.col("path"))).isin([n.lower() for n in GENERATED_NAMES]))


def non_empty(files: DataFrame) -> DataFrame:
    return files.where(F.col("text").isNotNull() & (F.col("text") != ""))
