"""Ignore rules and roots that are tables, of any number.

The forms in ``filters`` and ``functions.paths`` put every rule or root into
the plan.  Here both stay tables and meet the paths in hash joins:

* a rule is looked up by one part that each of its matches must have: of its
  literal segments and its literal extension the one that the fewest paths
  hold.  Only pairs with that part in common are compared by pattern;
* a root is looked up by the beginnings of a path.

Rules without any literal part (``**/tmp*``) are compared with every path.
Paths are distinct before the joins.  A part that many paths share is dealt over
``SALTS`` tasks; beginnings that many share are split by adaptive execution.

Defined cases: paths and rules are compared in any case; blank rule lines and
comments are no rules; null paths match nothing and are kept; empty tables of
rules or roots match nothing; of equal numbers the larger line, or the smaller
root, decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.functions import paths
from termscan.functions.folding import case_variants, folded
from termscan.functions.patterns import IGNORE_CASE

# Tasks that the paths of one part are spread over; rules are repeated as often.
SALTS = 16
SEGMENT_BELOW = r"[/\\]+[^/\\]+"


def _any_case(value: Column) -> Column:
    return folded(value, case_variants().values())


def glob_pattern(glob: Column) -> Column:
    """The regex of a path glob, as :func:`patterns.glob_regex` builds it on the driver."""
    literal = F.regexp_replace(glob, r"([\\.^$|+()\[\]{}])", r"\\$1")
    crossing = F.replace(literal, F.lit("**"), F.lit("\x00"))
    within = F.replace(F.replace(crossing, F.lit("?"), F.lit("[^/]")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit(f"{IGNORE_CASE}^(?:"), F.replace(within, F.lit("\x00"), F.lit(".*")), F.lit(")$"))


def parsed_rules(rules: DataFrame) -> DataFrame:
    """``rule_no, negated, glob`` of a table with ``rule_no, line``."""
    line = F.regexp_replace("line", r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    lines = rules.select("rule_no", line.alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    negated = F.startswith("line", F.lit("!"))
    rest = F.regexp_replace("line", r"^![\s\x1c-\x1f\x85\p{Z}]*", "")
    return lines.select("rule_no", negated.alias("negated"), F.when(negated, rest).otherwise(F.col("line")).alias("glob"))


def _parts_of_paths(path: Column) -> Column:
    """What a path can be found by: its segments, its extension, and what every path has."""
    segments = F.split(_any_case(paths.slashes(path)), "/")
    # No segment holds a separator, so these are apart from segments.
    extension = F.concat(F.lit("/."), F.substring_index(F.element_at(segments, -1), ".", -1))
    return F.array_distinct(F.concat(F.filter(segments, lambda s: s != ""), F.array(extension, F.lit("/"))))


def _parts_of_rules(glob: Column) -> Column:
    """Parts that whatever matches the rule must have."""
    segments = F.split(_any_case(glob), "/")
    literal = F.filter(segments, lambda s: (s != "") & ~F.rlike(s, F.lit(r"[*?]")))
    suffix = F.regexp_extract(F.element_at(segments, -1), r"\.([^.*?]*)$", 1)
    ends = F.rlike(F.element_at(segments, -1), F.lit(r"\.[^.*?]*$"))
    extension = F.when(ends, F.concat(F.lit("/."), suffix))
    return F.array_compact(F.concat(literal, F.array(extension, F.lit("/"))))


def last_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, rule_no, negated``: for each path the rule of ``rules`` (``rule_no, line``) that decides.

    The rule with the largest number among those that match.  Paths without
    one have no row.
    """
    each = files.select("path").where("path IS NOT NULL").distinct()
    parts = each.select("path", F.explode(_parts_of_paths(F.col("path"))).alias("part"))
    held = parts.groupBy("part").agg(F.count("*").alias("paths"))
    known = parsed_rules(rules).where("glob <> ''")
    wanted = known.select("*", F.explode(_parts_of_rules(F.col("glob"))).alias("part"))
    counted = wanted.join(held, "part", "left").withColumn("paths", F.coalesce("paths", F.lit(0)))
    rarest = counted.groupBy("rule_no", "negated", "glob").agg(F.min(F.struct("paths", "part")).alias("rarest"))
    keyed = rarest.where("rarest.paths > 0").select(
        "rule_no", "negated", "glob", F.col("rarest.part").alias("part"), glob_pattern(F.col("glob")).alias("pattern")
    )
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    repeated = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    matched = salted.join(repeated, ["part", "salt"]).where(F.rlike(paths.slashes(F.col("path")), F.col("pattern")))
    last = matched.groupBy("path").agg(F.max(F.struct("rule_no", "glob", "negated")).alias("last"))
    return last.select("path", "last.rule_no", "last.negated")


def apply_rule_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that the rules leave; the last matching rule wins, ``!`` brings back.

    Only paths go through the joins; other columns of ``files`` meet the
    excluded paths in one last join.
    """
    excluded = last_rules(files, rules).where("NOT negated").select("path")
    return files.join(excluded, "path", "left_anti").select(*files.columns)


def _beginnings(path: Column) -> Column:
    """Every beginning of a path that ends before separators and a further segment."""
    top = F.regexp_extract(path, r"^[^/\\]*", 0)
    below = F.regexp_extract_all(path, F.lit(SEGMENT_BELOW), F.lit(0))
    last = F.size(below) - 1
    depths = F.when(last >= 0, F.sequence(F.lit(0), last))
    return F.transform(depths, lambda depth: F.concat(top, F.array_join(F.slice(below, F.lit(1), depth), "")))


def first_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, root_id, root, repo`` of every distinct path below a root of ``roots`` (``root_id, root``).

    Of several roots above a path the one with the smallest id counts.  The
    repository is the first segment below it; a blank one reads ``(root)``.
    """
    stem = F.regexp_replace("root", r"[/\\]+$", "")
    stems = roots.where("root IS NOT NULL").select("root_id", "root", stem.alias("stem")).withColumn("key", _any_case(F.col("stem")))
    each = files.select("path").where("path IS NOT NULL").distinct()
    opened = each.select("path", F.explode(_beginnings(F.col("path"))).alias("above"))
    found = opened.withColumn("key", _any_case(F.col("above"))).join(stems, "key")
    first = found.groupBy("path").agg(F.min(F.struct("root_id", "root", F.length("above").alias("size"))).alias("first"))
    rest = F.substring(F.col("path"), F.col("first.size") + 1, F.length("path"))
    segment = F.regexp_extract(rest, r"^[/\\]+([^/\\]+)", 1)
    repo = F.when(F.trim(segment) == "", F.lit("(root)")).otherwise(segment)
    return first.select("path", "first.root_id", "first.root", repo.alias("repo"))


def with_repo(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with ``root_id, root, repo``; without a root the repository comes from the path alone."""
    named = first_roots(files, roots)
    joined = files.join(named, "path", "left")
    repo = F.coalesce(named["repo"], paths.repo_name(F.col("path"), ()))
    return joined.select(*[files[c] if c != "path" else F.col("path") for c in files.columns], "root_id", "root", repo.alias("repo"))
