"""Hits of files that are read in pieces, the same as if each file were one value.

A term found in a piece belongs to the piece in which it starts.  What crosses
a cut is carried from piece to piece:

* counts: a term that can overlap itself (``aa``, ``ana``) is counted for every
  offset at which counting may enter the piece, together with the offset at
  which it then enters the next one; the pieces of a file are chained by these.
  Other terms have one count, whatever comes before;
* context: a line that began in an earlier piece is completed from the first
  characters of that line, which every piece hands on;
* bucket: hints found in any piece.

Every piece is followed by ``ahead``, at least :func:`reach` characters of the
file, so nothing that starts in a piece is cut off.  Only rows per (piece, term)
and one row per piece leave the stage that holds texts.

Defined cases: a file of which any piece could not be read has one row with the
reason and no hits; a piece without text counts like any other.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termscan.functions.patterns import escape, is_blank, literal_alternatives, longest_match
from termscan.functions.text import CONTEXT_LENGTH, match_count, match_position, tidy_line
from termscan.operators import classify
from termscan.operators.matching import FOLDED, Term, alphabet, with_folded
from termscan.sources.sinks import stored

# A hint pattern whose matches may be longer is searched in whole texts only.
LONGEST_PATTERN = 65_536

CANDIDATE = "struct<term_id:int,term:string,needle:string,size:int,entries:int,pattern:string>"


def reach(terms: Sequence[Term], *hints: str | None) -> int | None:
    """Characters that must follow a piece; ``None`` if a hint pattern needs whole texts."""
    sizes = [CONTEXT_LENGTH, *[len(t.needle) for t in terms]]
    for pattern in hints:
        if is_blank(pattern):
            continue
        words = literal_alternatives(pattern)
        if words is not None:
            sizes += [len(w) for w in words]
            continue
        longest = longest_match(pattern)
        if longest is None or longest > LONGEST_PATTERN:
            return None
        sizes.append(longest)
    return max(sizes)


def overlaps_itself(needle: str) -> bool:
    """Whether a proper beginning of the needle is also its end."""
    return any(needle.startswith(needle[i:]) for i in range(1, len(needle)))


def _candidates(terms: Sequence[Term]) -> list[dict]:
    rows = [{"term_id": -1, "term": "", "needle": "", "size": 0, "entries": 0, "pattern": ""}]
    for term in terms:
        entries = len(term.needle) if overlaps_itself(term.needle) else 1
        rows.append(asdict(term) | {"size": len(term.needle), "entries": entries, "pattern": escape(term.needle)})
    return rows


def piece_rows(pieces: DataFrame, terms: Sequence[Term], planned: str | None, code: str | None) -> DataFrame:
    """One row per piece (``term_id`` -1) and one per piece and term in it, without texts.

    ``pieces`` has ``path, piece, text, ahead, skipped``.
    """
    letters = alphabet(terms) | classify.hint_alphabet(planned, code)
    whole = pieces.withColumn("own", F.length("text")).withColumn("text", F.concat("text", F.coalesce("ahead", F.lit(""))))
    every = F.from_json(F.lit(json.dumps(_candidates(terms))), f"array<{CANDIDATE}>")
    every = F.when(F.col("skipped").isNull(), every).otherwise(F.slice(every, 1, 1))
    exploded = with_folded(whole, letters).withColumn("candidate", F.explode(every))
    found = exploded.where(F.contains(F.col(FOLDED), F.col("candidate.needle")))

    text, low, own = F.col("text"), F.col(FOLDED), F.col("own")
    needle, size, entries = F.col("candidate.needle"), F.col("candidate.size"), F.col("candidate.entries")
    is_term, is_piece = F.col("candidate.term_id") >= 0, (F.col("candidate.term_id") < 0) & F.col("skipped").isNull()

    def run(start: Column) -> Column:
        """Matches from ``start`` on that begin in this piece, and how far the last reaches into the next."""
        part = F.substring(low, start, own + size - start)
        rest = F.length(F.element_at(F.split(part, F.col("candidate.pattern"), -1), -1))
        over = F.when(entries > 1, F.greatest(size - 1 - rest, F.lit(0))).otherwise(0)
        none = (start == 0) | (start > own)
        return F.struct(F.when(none, 0).otherwise(match_count(part, needle)).alias("n"), F.when(none, 0).otherwise(over).alias("over"))

    starts = F.transform(F.sequence(F.lit(0), entries - 1), lambda e: F.position(needle, low, e + 1))
    placed = found.withColumn("starts", F.when(is_term, starts)).withColumn("position", F.when(is_term, match_position(low, needle)))
    position = F.col("position")
    before = F.substring(text, F.lit(1), position - 1)
    after = F.substring_index(F.substring(text, position, F.lit(CONTEXT_LENGTH)), "\n", 1)
    own_text = F.substring(text, F.lit(1), own)
    return placed.select(
        "path", "piece", "skipped", F.col("candidate.term_id").alias("term_id"), F.col("candidate.term").alias("term"),
        "starts", F.when(is_term, F.transform(F.array_distinct("starts"), run)).alias("runs"),
        F.when(is_term, ~F.contains(before, F.lit("\n"))).alias("open"),
        F.when(is_term, F.substring(F.concat(F.substring_index(before, "\n", -1), after), 1, CONTEXT_LENGTH)).alias("line"),
        F.when(is_piece, classify.has_hint(text, low, planned)).alias("planned"),
        F.when(is_piece, classify.has_hint(text, low, code)).alias("code"),
        F.when(is_piece, F.contains(own_text, F.lit("\n"))).alias("ends_line"),
        F.when(is_piece, F.substring(F.substring_index(own_text, "\n", 1), 1, CONTEXT_LENGTH)).alias("first"),
        F.when(is_piece, F.substring(F.substring_index(own_text, "\n", -1), 1, CONTEXT_LENGTH)).alias("last"),
    )


def _opened_lines(marks: DataFrame) -> DataFrame:
    """``path, piece, opened``: the beginning of the line that a piece starts in."""
    order = Window.partitionBy("path").orderBy("piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A piece without a line end is longer than a context, so two pieces tell the beginning.
    broken = F.when(F.col("ends_line"), F.struct("piece", "last", F.lead("first").over(order).alias("next")))
    seen = marks.withColumn("broken", broken)
    lines = seen.select(
        "path", "piece", F.last("broken", ignorenulls=True).over(before).alias("broken"), F.first("first").over(before).alias("top")
    )
    apart = F.when(F.col("broken.piece") == F.col("piece") - 1, F.col("broken.last")).otherwise(F.concat("broken.last", "broken.next"))
    opened = F.when(F.col("broken").isNotNull(), apart).otherwise(F.coalesce("top", F.lit("")))
    return lines.select("path", "piece", opened.alias("opened"))


def _frequency(parts: Column) -> Column:
    """The pieces of a file chained: each is entered where the one before left it."""
    start = F.struct(F.lit(-1).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("over"))

    def chain(so_far: Column, part: Column) -> Column:
        entry = F.when(part["piece"] == so_far["piece"] + 1, F.least(so_far["over"], F.size(part["entries"]) - 1)).otherwise(0)
        chosen = F.get(part["entries"], entry)
        return F.struct(part["piece"].alias("piece"), (so_far["total"] + chosen["n"]).alias("total"), chosen["over"].alias("over"))

    return F.aggregate(parts, start, chain, lambda end: end["total"].cast("int"))


def matches_of_pieces(pieces: DataFrame, terms: Sequence[Term], planned: str | None, code: str | None) -> DataFrame:
    """``path, term, frequency, bucket, context, skipped`` of files in pieces.

    A file that could not be read is one row with ``skipped`` and nothing else.
    A group holds as many small entries as its file has pieces.
    """
    rows = stored(piece_rows(pieces, terms, planned, code), "pieces")
    unread = rows.where("skipped IS NOT NULL").groupBy("path").agg(F.min("skipped").alias("skipped"))
    marks = rows.where("term_id < 0 AND skipped IS NULL")
    buckets = marks.groupBy("path").agg(F.max("planned").alias("planned"), F.max("code").alias("code"))

    runs, firsts = F.col("runs"), F.array_distinct("starts")
    entries = F.transform("starts", lambda start: F.get(runs, F.array_position(firsts, start).cast("int") - 1))
    found = rows.where("term_id >= 0 AND runs[0].n > 0").withColumn("entries", entries)
    counted = found.groupBy("path", "term_id", "term").agg(
        F.array_sort(F.collect_list(F.struct("piece", "entries"))).alias("parts"),
        F.min(F.struct("piece", "open", "line")).alias("first"),
    ).select("path", "term", _frequency(F.col("parts")).alias("frequency"), "first.*")
    context = tidy_line(F.concat(F.when(F.col("open"), F.col("opened")).otherwise(""), F.col("line")))
    whole = counted.join(_opened_lines(marks), ["path", "piece"]).join(buckets, "path").join(unread, "path", "left_anti")
    hits = whole.select(
        "path", "term", "frequency", classify.bucket(F.col("planned"), F.col("code")).alias("bucket"), context.alias("context"),
        F.lit(None).cast("string").alias("skipped"),
    )
    return hits.unionByName(unread, allowMissingColumns=True)
