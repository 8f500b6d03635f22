"""The scan: files -> filters -> buckets -> hits -> tiers and summaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.functions import paths
from termscan.functions.patterns import is_blank, usable_pattern
from termscan.functions.text import line_context
from termscan.operators import classify, dedupe, filters, matching, pieces, ranking, reports, summaries
from termscan.operators.matching import FOLDED
from termscan.operators.reconcile import HIT_COLUMNS
from termscan.sources import sinks, trees
from termscan.spec import ScanSpec


@dataclass(frozen=True)
class Summaries:
    buckets: DataFrame
    tiers: DataFrame
    top_repos: DataFrame
    top_terms: DataFrame


@dataclass(frozen=True)
class ScanResult:
    """Tables over the hits; see :func:`stored_scan` to compute those of a file table only once."""

    hits: DataFrame
    tiers: DataFrame
    summaries: Summaries
    skipped: DataFrame | None = None  # path, reason: what a tree scan had to leave out


def select_files(files: DataFrame, spec: ScanSpec, roots: Sequence[str] | None = None) -> DataFrame:
    """All path filters of a spec; ``roots`` as they appear in the paths."""
    kept = filters.skip_output_directory(files, spec.output_dir, *spec.skip_dirs)
    kept = filters.skip_generated(kept)
    if spec.extensions:
        kept = filters.keep_extensions(kept, spec.extensions)
    lines = trees.rule_lines(
        files.sparkSession, spec.exclusion_patterns, spec.exclusion_files,
        trees.existing_roots(files.sparkSession, spec.include_paths), spec.ignore_file_name,
    )
    kept = filters.apply_rules(kept, lines)
    kept = filters.exclude_paths(kept, spec.exclude_dir_regex)
    kept = filters.exclude_files(kept, spec.exclude_file_regex)
    return filters.prune_directories(kept, spec.prune_dir_regex, spec.include_paths if roots is None else roots)


def classified(files: DataFrame, spec: ScanSpec, letters: Iterable[str] | None = None) -> DataFrame:
    """Add folded text, bucket, extension and repository.

    ``letters`` are those of the needles, if they are not the spec's terms.

    Empty texts need no filter of their own when terms are searched, since they
    hold none; a filter on a derived text would compute it a second time.
    """
    spark = files.sparkSession
    planned = usable_pattern(spark, spec.planned_hints_regex)
    code = usable_pattern(spark, spec.code_hints_regex)
    given = matching.alphabet(matching.vocabulary(spec.anchor_terms)) if letters is None else set(letters)
    letters = given | classify.hint_alphabet(planned, code)
    text, folded_text, path = F.col("text"), F.col(FOLDED), F.col("path")
    return matching.with_folded(files, letters).select(
        "path",
        *[c for c in files.columns if c == matching.SKIPPED],
        "text",
        FOLDED,
        paths.extension(path).alias("ext"),
        paths.repo_name(path, spec.include_paths).alias("repo"),
        classify.bucket(
            classify.has_hint(text, folded_text, planned), classify.has_hint(text, folded_text, code)
        ).alias("bucket"),
    )


def file_buckets(files: DataFrame, spec: ScanSpec) -> DataFrame:
    """``path, bucket`` of every non-empty file."""
    return classified(filters.non_empty(files), spec).select("path", "bucket")


def matches(files: DataFrame, spec: ScanSpec) -> DataFrame:
    """(file, term) rows with frequency and position of the first match."""
    terms = matching.vocabulary(spec.anchor_terms)
    return matching.match_terms(classified(files, spec), terms, spec.search)


def hit_rows(files: DataFrame, spec: ScanSpec, vocabulary: DataFrame | None = None) -> DataFrame:
    """The hit table.  One stage over the texts, no shuffle.

    Columns a caller drops are not computed: totals need neither bucket nor
    context.  ``vocabulary`` is a table with a column ``term`` that takes the
    place of the spec's terms; it may be larger than a driver holds.
    """
    if vocabulary is None:
        found = matches(files, spec)
    else:
        needles = sinks.stored(matching.folded_vocabulary(vocabulary), "vocabulary")
        found = matching.match_vocabulary(classified(files, spec, matching.table_alphabet(needles)), needles)
    return found.select(
        "term",
        "repo",
        F.col("path").alias("file"),
        "ext",
        "bucket",
        "frequency",
        line_context(F.col("text"), F.col("position")).alias("context"),
    ).select(*HIT_COLUMNS)


def distinct_hit_rows(files: DataFrame, spec: ScanSpec) -> DataFrame:
    """The hit table with one file per path, any case.

    Hits are compared, not texts: those of files that are not the first of
    their path go, and the equal hits of exact copies collapse.
    """
    key = F.xxhash64("text").alias("text_key")
    context = line_context(F.col("text"), F.col("position")).alias("context")
    found = matches(files, spec).select(
        "term", "repo", F.col("path").alias("file"), "ext", "bucket", "frequency", context, key
    )
    repeated = dedupe.repeated_paths(files)
    joined = found.join(repeated, F.lower("file") == F.col("path_key"), "left")
    first = (F.col("file") == F.col("first_path")) & (F.col("text_key") == F.col("first_text"))
    kept = joined.where(F.col("path_key").isNull() | first)
    return kept.select(*HIT_COLUMNS, "text_key").distinct().select(*HIT_COLUMNS)


def result_of(hits: DataFrame, spec: ScanSpec) -> ScanResult:
    tiers = ranking.term_tiers(hits, spec.crest_threshold, spec.slopes_threshold)
    return ScanResult(
        hits,
        tiers,
        Summaries(
            summaries.bucket_distribution(hits, spec.any_case_groups),
            summaries.tier_distribution(tiers),
            summaries.top_repos(hits, any_case=spec.any_case_groups),
            summaries.top_terms(tiers),
        ),
    )


def scan_files(files: DataFrame, spec: ScanSpec) -> ScanResult:
    """Scan a table of ``path, length, text``."""
    kept = filters.max_megabytes(select_files(files, spec), spec.max_file_mb)
    return result_of(distinct_hit_rows(kept, spec) if spec.dedupe else hit_rows(kept, spec), spec)


def _tree_rows(listing: DataFrame, spec: ScanSpec) -> DataFrame:
    """Hits of the files of a listing; one row with the reason as its term for a file that was not read.

    Files longer than ``piece_bytes`` are read in pieces, unless a hint pattern
    can be decided on whole texts only: then they are read whole, and those too
    long for one value have a reason.
    """
    spark = listing.sparkSession
    terms = matching.vocabulary(spec.anchor_terms)
    hints = [usable_pattern(spark, p) for p in (spec.planned_hints_regex, spec.code_hints_regex)]
    reach = pieces.reach(terms, *hints)
    whole = trees.MAX_VALUE_BYTES if reach is None else min(spec.piece_bytes, trees.MAX_VALUE_BYTES)
    most = spec.longest_text_bytes or (whole if reach is None else None)
    long = F.col("length") > whole
    if most is not None:
        long = long & (F.col("length") <= most)
    rows = hit_rows(trees.read_or_skipped(listing.where(~long), most), spec)
    if reach is None or listing.where(long).isEmpty():
        return rows
    found = pieces.matches_of_pieces(trees.read_pieces(listing.where(long), spec.piece_bytes, reach), terms, *hints)
    path = F.col("path")
    named = found.withColumns({
        "term": F.coalesce("term", "skipped"), "file": path, "ext": paths.extension(path),
        "repo": paths.repo_name(path, spec.include_paths),
    })
    return rows.unionByName(named.select(*rows.columns))


def scan(spark: SparkSession, spec: ScanSpec) -> ScanResult:
    """Scan the file trees named by the spec.

    The listing is filtered by path and size first; only what is left is read,
    each file once: hits and what could not be read are stored together in the
    checkpoint folder and told apart there.  With ``include_hidden`` off, Spark's own file source lists and reads, which
    passes over names that start with ``.`` or ``_``.
    """
    spec = spec.normalized().validate(spark)
    # Paths are compared without their scheme, so roots are too.
    plain = replace(spec, include_paths=[paths.plain_path(root) for root in spec.include_paths])
    if spec.include_hidden:
        everything = trees.walk_everything(spark, spec.include_paths, spec.prune_dir_regex, spec.dedupe)
        listing = everything.where("skipped IS NULL").drop("skipped")
        kept = filters.max_megabytes(select_files(listing, spec, plain.include_paths), spec.max_file_mb)
        found = sinks.stored(_tree_rows(kept, plain), "scan")
        unread = found.where("frequency IS NULL").select(F.col("file").alias("path"), F.col("term").alias("reason"))
        hits = found.where("frequency IS NOT NULL")
        return replace(result_of(hits, spec), skipped=trees.unlisted(everything).unionByName(unread))
    listing = trees.read_tree(spark, spec.include_paths, spec.extensions, spec.dedupe)
    files = filters.max_megabytes(select_files(listing, spec, plain.include_paths), spec.max_file_mb)
    everything = trees.list_tree(spark, spec.include_paths, spec.extensions, spec.dedupe).drop("content")
    kept = filters.max_megabytes(select_files(everything, spec, plain.include_paths), spec.max_file_mb)
    return replace(result_of(hit_rows(files, plain), spec), skipped=trees.left_out(spark, spec.include_paths, kept))


def stored_scan(result: ScanResult, spec: ScanSpec, path: str | None = None) -> ScanResult:
    """Write the hits once and derive everything else from the stored table."""
    hits = sinks.write_hits(result.hits, path) if path else sinks.stored(result.hits, "hits")
    return replace(result_of(hits, spec), skipped=result.skipped)


def write_reports(result: ScanResult, spec: ScanSpec, output_dir: str | None = None) -> ScanResult:
    """Hit table as parquet and CSV, word map, summary and charts.

    Without any hit nothing but the empty hit table is written.
    """
    folder = output_dir or spec.output_dir
    if is_blank(folder):
        raise ValueError("no output directory given")
    folder = folder.rstrip("/\\")
    kept = stored_scan(result, spec, f"{folder}/hits.parquet")
    if kept.hits.isEmpty():
        return kept
    thresholds = (spec.crest_threshold, spec.slopes_threshold)
    sinks.write_hits_csv(kept.hits, f"{folder}/wordmap_raw")
    sinks.write_lines(reports.word_map_lines(kept.hits, *thresholds), f"{folder}/wordmap_table")
    sinks.write_lines(reports.summary_lines(kept.hits, *thresholds), f"{folder}/summary")
    sinks.write_lines(reports.chart_lines(kept.hits, *thresholds), f"{folder}/visuals")
    return kept


def show_summaries(result: ScanResult) -> None:
    """Print the four summary tables."""
    tables = result.summaries
    for title, table in (
        ("Buckets", tables.buckets), ("Tiers", tables.tiers),
        ("Top Repos", tables.top_repos), ("Top Terms", tables.top_terms),
    ):
        print(title)
        table.show(truncate=False)
