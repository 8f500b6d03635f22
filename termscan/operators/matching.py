"""Files x terms: which terms occur in which text.

The vocabulary is configuration, so it travels inside the plan; texts are never
shuffled or sorted.  Two plans give the same rows, and the caller chooses
(``ScanSpec.search``):

* ``each``: every text is searched once per term inside generated code, for
  vocabularies of up to some hundred terms;
* ``layers``: one pass over Arrow batches of texts per prefix-free layer, the
  terms whose first grams have one length, finds and counts all terms, for thousands.

A vocabulary that is data rather than configuration stays a table
(:func:`match_vocabulary`): a term can only occur where its first characters
do, so the short character grams of a text are joined to those seeds, and only
the terms found that way are compared with the text.

Terms are counted independently of each other, so nested terms
(``light``, ``lightning``) both count.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.functions import grams
from termscan.functions.folding import case_variants, fold_string, folded
from termscan.functions.patterns import escape, is_blank
from termscan.functions.text import match_count, match_position

SEARCHES = ("each", "layers")
# Longest alternation put into one pattern; a longer layer becomes several
# patterns of the same projection, over the same scan.
CHARS_PER_PATTERN = 50_000

# A vocabulary is sent to every task up to this size, measured before; a larger one is shuffled.
MOST_BROADCAST_BYTES = 16 * 1024 * 1024
# What a row takes beside its strings.
ROW_BYTES = 104

FOLDED = "folded_text"
SKIPPED = "skipped"
ENTRY = "struct<term_id:int,term:string,needle:string>"


@dataclass(frozen=True)
class Term:
    term_id: int
    term: str
    needle: str


def vocabulary(terms: Iterable[str]) -> list[Term]:
    """Distinct terms, any case, first spelling kept; blanks dropped."""
    by_needle: dict[str, Term] = {}
    for term_id, term in enumerate(terms):
        if not is_blank(term):
            needle = fold_string(term)
            by_needle.setdefault(needle, Term(term_id, term, needle))
    return list(by_needle.values())


def alphabet(terms: Iterable[Term]) -> set[str]:
    return {char for term in terms for char in term.needle}


def distinct_terms(terms: DataFrame, order: Sequence[str] = ("term_id",)) -> DataFrame:
    """The same rule for a table with ``term`` and order columns: the first spelling stays."""
    named = terms.where(F.rlike("term", F.lit(r"[^\p{Z}\s\x1c-\x1f\x85]")))
    key = folded(F.col("term"), case_variants().values())
    first = named.groupBy(key.alias("key")).agg(F.min(F.struct(*order, "term")).alias("first"))
    return first.select(*[F.col(f"first.{c}").alias(c) for c in [*order, "term"]])


def with_folded(files: DataFrame, letters: Iterable[str]) -> DataFrame:
    return files.withColumn(FOLDED, folded(F.col("text"), letters))


def match_terms(files: DataFrame, terms: Sequence[Term], search: str = "each") -> DataFrame:
    """One row per (file, term) with at least one match.

    ``files`` carries ``text`` and the folded text; added are ``term_id``,
    ``term``, ``frequency`` and ``position`` of the first match.

    If ``files`` has a column ``skipped``, a file with a reason there was not
    read: it is one row that has the reason as its term and no frequency.  So
    hits and what is left out come from the same pass over the files.
    """
    if search not in SEARCHES:
        raise ValueError(f"search must be one of {SEARCHES}")
    return _search_layers(files, terms) if search == "layers" and terms else _search_each(files, terms)


def _measured(matched: DataFrame, columns: list[str], term: str) -> DataFrame:
    needle = F.col(f"{term}.needle")
    return matched.select(
        *columns,
        F.col(f"{term}.term_id").alias("term_id"),
        F.col(f"{term}.term").alias("term"),
        match_count(F.col(FOLDED), needle).alias("frequency"),
        match_position(F.col(FOLDED), needle).alias("position"),
    )


def _search_each(files: DataFrame, terms: Sequence[Term]) -> DataFrame:
    # A constant that the optimizer folds into the plan.
    constant = F.from_json(F.lit(json.dumps([asdict(t) for t in terms])), f"array<{ENTRY}>")
    if SKIPPED in files.columns:
        # Every text contains the empty needle, also one that was not read.
        reason = F.struct(F.lit(-1).alias("term_id"), F.col(SKIPPED).alias("term"), F.lit("").alias("needle"))
        constant = F.when(F.col(SKIPPED).isNull(), constant).otherwise(F.array(reason))
    rows = files.withColumn("candidate", F.explode(constant))
    found = rows.where(F.contains(F.col(FOLDED), F.col("candidate.needle")))
    return _measured(found, files.columns, "candidate")


def _search_layers(files: DataFrame, terms: Sequence[Term]) -> DataFrame:
    # First grams of one length hold no prefix of each other, so each length is a layer.
    counted = grams.needle_counts(F.col(FOLDED), [t.needle for t in terms])
    found = files.withColumn("found", counted)
    table = [(place, *astuple(t)) for place, t in enumerate(terms)]
    if SKIPPED in files.columns:
        # Every text contains the empty needle, also one that was not read.
        reason = F.array(F.struct(F.lit(-1).alias("needle"), F.lit(None).cast("int").alias("n")))
        found = found.withColumn("found", F.when(F.col(SKIPPED).isNull(), F.col("found")).otherwise(reason))
        table.append((-1, -1, None, ""))
    rows = found.withColumn("found", F.explode("found"))
    # The table is the vocabulary, which the driver holds already.
    entries = files.sparkSession.createDataFrame(table, "place int, term_id int, term string, needle string")
    measured = rows.join(F.broadcast(entries), F.col("found.needle") == F.col("place")).select(
        *files.columns, "term_id", "term", F.col("found.n").alias("frequency"),
        match_position(F.col(FOLDED), F.col("needle")).alias("position"),
    )
    return measured.withColumn("term", F.coalesce("term", SKIPPED)) if SKIPPED in files.columns else measured


def folded_vocabulary(terms: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``term, needle, size, seed`` of a table of terms: distinct in any case, without blanks.

    ``seed`` is the first gram of the needle, ``size`` that gram's length.

    Of several spellings the first by ``order`` stays, or the smallest.
    """
    named = distinct_terms(terms, order)
    needle = folded(F.col("term"), case_variants().values())
    first = named.select("term", needle.alias("needle"))
    return first.select("*", grams.gram_size(F.col("needle")).alias("size"), grams.first_gram(F.col("needle")).alias("seed"))


def table_alphabet(needles: DataFrame) -> set[str]:
    """The characters of all needles; there are no more of them than characters."""
    chars = needles.select(F.explode(F.split("needle", "")).alias("char")).distinct()
    return {row["char"] for row in chars.collect()}


def match_vocabulary(files: DataFrame, needles: DataFrame) -> DataFrame:
    """The rows of :func:`match_terms` (without ``term_id``) for a vocabulary of any size, as a table.

    ``files`` is folded for the needles' alphabet.  A vocabulary within
    ``MOST_BROADCAST_BYTES`` goes to every task and is searched in layers, so
    texts stay where they are.  Beyond it the grams of a text are extracted in
    one linear pass for each seed length in use, (file, gram) pairs meet the
    seeds in a shuffle, and files are joined to the terms they may hold.
    """
    sizes = needles.groupBy("size").agg(F.sum(F.octet_length("term") + F.octet_length("needle") + ROW_BYTES).alias("bytes")).collect()
    held = sum(row["bytes"] for row in sizes)
    columns = files.columns
    if held <= MOST_BROADCAST_BYTES:
        terms = [Term(i, *row) for i, row in enumerate(needles.select("term", "needle").collect())]
        return _search_layers(files, terms).drop("term_id")
    key = [F.col("path").alias("_path"), F.xxhash64("text").alias("_text")]
    each = files.dropDuplicates(["path", "text"]).select(*key, grams.all_grams(F.col(FOLDED), [row["size"] for row in sizes]).alias("_gram"))
    pairs = each.withColumn("_gram", F.explode("_gram"))
    may_hold = pairs.join(needles, F.col("_gram") == F.col("seed")).select("_path", "_text", "term", "needle")
    found = files.join(may_hold, (F.col("path") == F.col("_path")) & (F.xxhash64("text") == F.col("_text")))
    held_in = found.where(F.contains(F.col(FOLDED), F.col("needle")))
    return held_in.select(
        *columns, "term", match_count(F.col(FOLDED), F.col("needle")).alias("frequency"),
        match_position(F.col(FOLDED), F.col("needle")).alias("position"),
    )


def _patterns(layer: Sequence[str]) -> list[str]:
    """A layer as patterns of bounded length; neighbours in order stay together."""
    runs: list[list[str]] = [[]]
    size = 0
    for needle in sorted(layer):
        if runs[-1] and size + len(needle) > CHARS_PER_PATTERN:
            runs.append([])
            size = 0
        runs[-1].append(needle)
        size += len(needle)
    return [_lookahead(run) for run in runs if run]


def prefix_free_layers(needles: Iterable[str]) -> list[list[str]]:
    """Split needles so that none is a prefix of another in its layer.

    Within a layer at most one needle can start at a given position, so one
    alternation finds them all.  The layer of a needle is the number of other
    needles that are prefixes of it.
    """
    known = set(needles)
    layers: dict[int, list[str]] = {}
    for needle in sorted(known):
        depth = sum(needle[:end] in known for end in range(1, len(needle)))
        layers.setdefault(depth, []).append(needle)
    return [layers[depth] for depth in sorted(layers)]


def _lookahead(needles: Sequence[str]) -> str:
    """Zero-width pattern capturing whichever needle starts at each position."""
    return f"(?=({_alternation(sorted(needles))}))"


def _alternation(needles: Sequence[str]) -> str:
    """Alternation of sorted, prefix-free strings with shared prefixes factored out."""
    groups: dict[str, list[str]] = {}
    for needle in needles:
        groups.setdefault(needle[0], []).append(needle)
    branches = []
    for members in groups.values():
        shared = _shared_prefix(members[0], members[-1])
        rest = [m[len(shared):] for m in members]
        branches.append(escape(shared) + (_alternation(rest) if len(rest) > 1 else ""))
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _shared_prefix(first: str, last: str) -> str:
    """Common prefix of a sorted list, given its two ends."""
    size = 0
    while size < min(len(first), len(last)) and first[size] == last[size]:
        size += 1
    return first[:size]
