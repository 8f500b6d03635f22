"""Named queries over the test tables; ``oracle.py`` holds the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.functions import paths
from termscan.functions.text import with_text
from termscan.operators import dedupe, digests, filters, matching, path_tables, ranking, reconcile, reports, summaries
from termscan.plans import scan
from termscan.sources import sinks, trees
from termscan.sources.tables import in_partitions, texts_as_files
from termscan.spec import ScanSpec

Query = Callable[[SparkSession, str], DataFrame]

# Where each document would lie in a file tree.  Plain SQL that reads the same
# in both engines.
DOCUMENT_PATH = """concat('/corpus/', source, '/',
    CASE WHEN source = 'src7' THEN 'bin' WHEN source = 'src13' THEN 'out_cli' ELSE lang END, '/',
    CAST(doc_id AS STRING),
    CASE WHEN source = 'src11' THEN '/SUMMARY' WHEN source = 'src5' AND lang <> 'fr' THEN ' (old)' ELSE '' END,
    CASE lang WHEN 'en' THEN '.MD' WHEN 'de' THEN '.txt' WHEN 'es' THEN '.html' ELSE '.Py' END)"""
TURN_PATH = "concat('/talk/', role, '/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING), '.txt')"
# A second edition of the documents: license lines cut off.
EDITION_CUT = "[Ll]icense[^\n]*"

TERMS = ["the", "THE", "tion", "ing", "eau", "ción", "ver", "über", "hehely", "quei", "thatin",
         "ononst", "schver", "license", "@", "worthless", "clown", "http", " "]
EDITION_TERMS = [t for t in TERMS if t != "http"] + ["and"]
PAGE_TERMS = ["<nav", "href", "</p>", "&amp;", "the", "Über", "été", "cookie", "script", "example.com", "a.b"]
TURN_TERMS = ["the", "que", "ung", "ción", "?", "por", "haben", "é"]
# A vocabulary by rule, with terms that are prefixes of others: "ba", "ban", "be", "ben", ...
SYLLABLES = [c + v + end for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou" for end in ("", "n")]
PLANNED = "worthless|ondor|schver|quei"
CODE = "ingha|eaux|unglich|mente"
PLANNED_REGEX = "licen[cs]e|https?://|[0-9]{3}-[0-9]{4}"
CODE_REGEX = "(ing|tion)ha|e.ux|ung(en)?[.]"

SPEC = ScanSpec(include_paths=["/corpus/"], anchor_terms=TERMS, planned_hints_regex=PLANNED, code_hints_regex=CODE)
EDITION_SPEC = ScanSpec(include_paths=["/corpus/"], anchor_terms=EDITION_TERMS,
                        planned_hints_regex="worthless|ondor", code_hints_regex=CODE)
FILTERED_SPEC = ScanSpec(
    include_paths=["/corpus/"], anchor_terms=TERMS, planned_hints_regex=PLANNED_REGEX, code_hints_regex=CODE_REGEX,
    extensions=["*.md", ".txt", "HTML"], exclude_dir_regex=r"(^|[\\/])out_cli([\\/]|$)",
    exclude_file_regex=r" \(old\)\.[a-z]+$",
    exclusion_patterns=["# build output", "**/bin/**", "!**/bin/*.md"],
    crest_threshold=0.66, slopes_threshold=0.33, max_file_mb=2, output_dir="/corpus/src3/",
)
PAGE_SPEC = ScanSpec(anchor_terms=PAGE_TERMS, planned_hints_regex="lorem|cookie", code_hints_regex="script|function")
TURN_SPEC = ScanSpec(include_paths=["/talk/"], anchor_terms=TURN_TERMS, planned_hints_regex="que|wie", code_hints_regex="[0-9]+")

# A scan of files, one per document, that lie under TREE.
TREE = "/tree"
TREE_RULES = ["# kept out", "**/source=src7/**", "!**/source=src7/lang=en/**"]
TREE_SPEC = ScanSpec(
    include_paths=[f"{TREE}/source=src0/", f"{TREE}/", f"{TREE}/nowhere/"], extensions=["txt"], anchor_terms=TERMS,
    planned_hints_regex=PLANNED, code_hints_regex=CODE, prune_dir_regex="/lang=de$", exclude_dir_regex="/source=src13(/|$)",
    exclude_file_regex="/doc_id=[0-9]*7/", exclusion_patterns=["**/source=src5/lang=fr/**"], max_file_mb=2,
    output_dir=f"{TREE}/source=src1",
)
SKIPPING_SPEC = replace(TREE_SPEC, longest_text_bytes=2000)
BROKEN_SPEC = replace(SPEC, planned_hints_regex="[broken")

EXTENSIONS = ["*.md", ".txt", "PY"]
RULES = ["# comment", "", "**/bin/**", "**/out_cli/*", "!**/*.md", "/corpus/src?/en/*", "!/corpus/src4/**", "/corpus/*.txt"]
PATH_REGEX = r"(^|[\\/])(bin|out_cli)([\\/]|$)"
FILE_REGEX = r" \(old\)\.[a-z]+$"
PRUNE_REGEX = "/(bin|out_cli)$"
SIZE_LIMIT = 8192
PIECE_BYTES = 4096
OUTPUT_DIR = "/CORPUS/src1/"
ORDERED_ROOTS = ["/corpus/src1/", "/CORPUS/", "/corpus/src2/"]
OTHER_ROOTS = ["/corpus/src2", "/elsewhere/"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table as files."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return in_partitions(texts_as_files(table, F.expr(DOCUMENT_PATH), F.col("text")))


def second_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return texts_as_files(files, F.col("path"), F.regexp_replace("text", EDITION_CUT, ""))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return in_partitions(texts_as_files(table, F.col("url"), F.col("html")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return in_partitions(texts_as_files(table, F.expr(TURN_PATH), F.col("text")))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hit_rows(documents(spark, sf_dir), SPEC)


def _edition_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hit_rows(second_edition(spark, sf_dir), EDITION_SPEC)


def _on_hits(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_hits(spark, sf_dir))


def _on_files(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir)).select("path", "length")


def _on_pair(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_hits(spark, sf_dir), _edition_hits(spark, sf_dir))


def _buckets(spec: ScanSpec) -> Query:
    return lambda spark, sf_dir: scan.file_buckets(documents(spark, sf_dir), spec)


def hit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.matches(documents(spark, sf_dir), SPEC)
    context = scan.line_context(F.col("text"), F.col("position")).alias("context")
    return found.select("path", "term", "position", context)


def repo_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return documents(spark, sf_dir).select(
        "path",
        paths.repo_name(path, SPEC.include_paths).alias("repo"),
        paths.repo_name(path, OTHER_ROOTS).alias("other_repo"),
        paths.extension(path).alias("ext"),
        paths.base_name(path).alias("base_name"),
    )


def first_root_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return documents(spark, sf_dir).select(
        "path", paths.first_root(path, ORDERED_ROOTS).alias("root"), paths.repo_name(path, ORDERED_ROOTS).alias("repo")
    )


def glob_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore rules that grow with the table: the fixed ones, then one for every tenth document."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.concat(F.when(F.col("doc_id") % 20 == 13, F.lit("!")).otherwise(F.lit("")), F.expr(DOCUMENT_PATH))
    each = table.where("doc_id % 10 = 3").select((F.col("doc_id") + len(RULES)).alias("rule_no"), own.alias("line"))
    fixed = spark.createDataFrame(list(enumerate(RULES)), "rule_no long, line string")
    files = documents(spark, sf_dir).select("path", "length")
    return path_tables.apply_rule_table(files, fixed.unionByName(each))


def first_root_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that come from the table: one per source and language, then one above them all."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = F.concat(F.lit("/CORPUS/"), "source", F.lit("/"), "lang", F.lit("/"))
    roots = table.groupBy(root.alias("root")).agg(F.min("doc_id").alias("root_id")).select("root_id", "root")
    last = spark.createDataFrame([(2**40, "/corpus")], "root_id long, root string")
    return path_tables.with_repo(documents(spark, sf_dir).select("path"), roots.unionByName(last))


def overlapping_roots_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = dedupe.files_per_root(documents(spark, sf_dir), ORDERED_ROOTS)
    return dedupe.distinct_files(every.select("path", "length", "root_id"), ["root_id", "path"])


def vocab_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.select("item_id", F.posexplode(F.split("text", " ")).alias("place", "term"))
    return matching.distinct_terms(words, ["item_id", "place"])


def filtered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_files(documents(spark, sf_dir), FILTERED_SPEC).hits


def filtered_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_files(documents(spark, sf_dir), FILTERED_SPEC).tiers


def term_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.term_tiers(_hits(spark, sf_dir))


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.scan_counts(documents(spark, sf_dir), _hits(spark, sf_dir))


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hit_rows(pages(spark, sf_dir), PAGE_SPEC)


def turn_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hit_rows(turns(spark, sf_dir), TURN_SPEC)


def same_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself in another row order."""
    hits = _hits(spark, sf_dir)
    return reconcile.equality(hits, hits.repartition("file"))


def _on_kept_pair(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """For operators that read their tables twice: the hits are found once and kept."""
    return lambda spark, sf_dir: operator(
        sinks.stored(_hits(spark, sf_dir), "left"), sinks.stored(_edition_hits(spark, sf_dir), "right"))


def _on_stored_pair(compare: Callable[[SparkSession, str, str], DataFrame]) -> Query:
    """Both hit tables written with their digests, then compared from what is stored."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folders = [sinks.new_folder(spark, name) for name in ("left", "right")]
        for hits, folder in zip((_hits(spark, sf_dir), _edition_hits(spark, sf_dir)), folders):
            sinks.write_hits_with_digests(hits, folder)
        return compare(spark, *folders)
    return run


def tree_repo_totals(spark: SparkSession, sf_dir: str, piece_bytes: int = ScanSpec.piece_bytes) -> DataFrame:
    """The documents written out as text files, then scanned as a file tree.

    Rebalancing gives each (source, lang) few files of moderate size and cuts
    a dominant source into several.  Files longer than ``piece_bytes`` are read
    in pieces.
    """
    root = sinks.new_folder(spark, "tree")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
    writer = table.hint("rebalance", "source", "lang").write.partitionBy("source", "lang")
    writer.option("maxRecordsPerFile", 20_000).text(root)
    spec = ScanSpec(include_paths=[root], extensions=["*.txt"], anchor_terms=TERMS, piece_bytes=piece_bytes)
    totals = scan.scan(spark, spec).hits.groupBy("term", "repo", "ext")
    return totals.agg(F.sum("frequency").alias("total"))


def large_vocabulary_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of more terms than are searched one by one."""
    return ranking.term_tiers(scan.hit_rows(documents(spark, sf_dir), ScanSpec(anchor_terms=SYLLABLES, search="layers")))


def csv_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit table after a round through CSV."""
    path = sinks.new_folder(spark, "hits-csv")
    sinks.write_hits_csv(_hits(spark, sf_dir), path)
    return trees.read_hits(spark, path)


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a file of its own: /source=../lang=../doc_id=../part-*.txt."""
    root = sinks.new_folder(spark, "tree")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "doc_id", "text")
    sinks.write_text_tree(table, root, ["source", "lang", "doc_id"])
    return root


def _place(path: Column, root: str) -> Column:
    """Where a file of a document tree lies, without the tree's own place and the part's name."""
    inner = F.substring(path, F.lit(len(paths.plain_path(root)) + 1), F.length(path))
    return F.regexp_replace(F.concat(F.lit(TREE), inner), "/[^/]*$", "")


def tree_largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest files of a tree, from the listing alone."""
    root = document_tree(spark, sf_dir)
    listing = trees.walk_tree(spark, [root]).where(F.endswith("path", F.lit(".txt")))
    largest = summaries.largest_files(listing.withColumn("path", _place(F.col("path"), root)))
    return largest.select("path", "length")


def _tree_result(spark: SparkSession, sf_dir: str, spec: ScanSpec = TREE_SPEC) -> tuple[scan.ScanResult, str]:
    """A scan of a document tree with every filter, nested roots, a missing one and a rule file."""
    root = document_tree(spark, sf_dir)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rule_file = jvm.org.apache.hadoop.fs.Path(f"{root}/.scanignore")
    stream = rule_file.getFileSystem(conf).create(rule_file)
    stream.write(bytearray("\n".join(TREE_RULES).encode()))
    stream.close()
    moved = replace(spec, include_paths=[p.replace(TREE, root, 1) for p in spec.include_paths],
                    output_dir=spec.output_dir.replace(TREE, paths.plain_path(root), 1))
    return scan.scan(spark, moved), root


def tree_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, root = _tree_result(spark, sf_dir)
    return result.hits.withColumn("file", _place(F.col("file"), root))


def tree_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_lines(scan.stored_scan(_tree_result(spark, sf_dir)[0], TREE_SPEC).hits)


def tree_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan of the tree had to leave out: the missing root, and files longer than it may read."""
    result, root = _tree_result(spark, sf_dir, SKIPPING_SPEC)
    path = F.replace(F.col("path"), F.lit(paths.plain_path(root)), F.lit(TREE))
    return result.skipped.select(F.regexp_replace(path, "/part-[^/]*$", "").alias("path"), "reason")


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded in one of four ways by its id and decoded again."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    way = F.pmod("doc_id", F.lit(4))
    content = (
        F.when(way == 0, F.encode("text", "UTF-8"))
        .when(way == 1, F.encode("text", "UTF-16"))
        .when(way == 2, F.concat(F.unhex(F.lit("0000FEFF")), F.encode("text", "UTF-32")))
        .otherwise(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    )
    return with_text(table.select("doc_id", content.alias("content")))


def duplicate_paths_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents stacked on themselves: exact copies count once."""
    files = documents(spark, sf_dir)
    return scan.scan_files(files.unionByName(files), SPEC).tiers


def unique_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by path, each once."""
    files = documents(spark, sf_dir).select("path", "length")
    return dedupe.distinct_files(files.unionByName(files)).orderBy("path")


def mixed_spelling_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in two spellings; the one with the smaller term_id names the term."""
    found = scan.matches(documents(spark, sf_dir), SPEC)
    loud = F.length("path") % 2 == 0
    spelled = found.select(
        F.when(loud, F.upper("term")).otherwise(F.col("term")).alias("term"),
        (F.col("term_id") * 2 + F.when(loud, 0).otherwise(1)).alias("term_id"), "frequency",
    )
    return ranking.term_tiers(spelled)


def benchmark_vocabulary_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of all words of the benchmark items: a vocabulary that is a table, of any size."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.select(F.explode(F.split(F.lower("text"), r"[ \n.,]+")).alias("term"))
    return ranking.term_tiers(scan.hit_rows(documents(spark, sf_dir), ScanSpec(), words))


def csv_sorted_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit table after a round through sorted CSV, with its place in the files' order."""
    path = sinks.new_folder(spark, "hits-sorted-csv")
    sinks.write_hits_csv_sorted(_hits(spark, sf_dir), path)
    return trees.read_hits(spark, path)


def backslash_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the other separator; a blank segment below the root is named."""
    blank = F.when(F.col("path").contains("/en/"), F.regexp_replace("path", "^/corpus/[^/]+", "/corpus/ ")).otherwise(F.col("path"))
    path = F.translate(blank, "/", "\\")
    table = documents(spark, sf_dir).select(path.alias("path"))
    path = F.col("path")
    return table.select(
        "path", paths.slashes(path).alias("slashed"), paths.repo_name(path, ["\\corpus\\"]).alias("repo"),
        paths.extension(path).alias("ext"), paths.base_name(path).alias("base_name"),
    )


def emptied_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of what is left when every third text is emptied."""
    emptied = F.when(F.col("length") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return scan.file_buckets(documents(spark, sf_dir).withColumn("text", emptied), SPEC)


QUERIES: dict[str, Query] = {
    "term_tiers": term_tiers,
    "doc_buckets": _buckets(SPEC),
    "doc_buckets_regex": _buckets(FILTERED_SPEC),
    "term_hits": _hits,
    "hit_context": hit_context,
    "ext_filter": _on_files(lambda files: filters.keep_extensions(files, EXTENSIONS)),
    "path_regex_exclude": _on_files(lambda files: filters.exclude_paths(files, PATH_REGEX)),
    "file_regex_exclude": _on_files(lambda files: filters.exclude_files(files, FILE_REGEX)),
    "dir_exclude": _on_files(lambda files: filters.prune_directories(files, PRUNE_REGEX, ["/corpus/"])),
    "glob_exclude_last_match": _on_files(lambda files: filters.apply_rules(files, RULES)),
    "size_filter": _on_files(lambda files: filters.max_bytes(files, SIZE_LIMIT)),
    "own_output_exclude": _on_files(lambda files: filters.skip_output_directory(files, OUTPUT_DIR)),
    "generated_exclude": _on_files(filters.skip_generated),
    "repo_attribution": repo_attribution,
    "first_root_match": first_root_match,
    "bucket_distribution": _on_hits(summaries.bucket_distribution),
    "tier_distribution": _on_hits(lambda hits: summaries.tier_distribution(ranking.term_tiers(hits))),
    "top_repos": _on_hits(summaries.top_repos),
    "top_terms": _on_hits(lambda hits: summaries.top_terms(ranking.term_tiers(hits))),
    "largest_files": lambda spark, sf_dir: summaries.largest_files(documents(spark, sf_dir)),
    "scan_counts": scan_counts,
    "top_example": _on_hits(ranking.top_examples),
    "wordmap_lines": _on_hits(reports.word_map_lines),
    "summary_lines": _on_hits(reports.summary_lines),
    "pie_lines": _on_hits(reports.chart_lines),
    "overlapping_roots_all": lambda spark, sf_dir: dedupe.files_per_root(
        documents(spark, sf_dir), ORDERED_ROOTS).select("path", "length", "root_id"),
    "overlapping_roots_distinct": overlapping_roots_distinct,
    "vocab_distinct": vocab_distinct,
    "large_vocabulary_tiers": large_vocabulary_tiers,
    "filtered_hits": filtered_hits,
    "filtered_tiers": filtered_tiers,
    "page_hits": page_hits,
    "page_tiers": lambda spark, sf_dir: ranking.term_tiers(page_hits(spark, sf_dir)),
    "page_top_repos": lambda spark, sf_dir: summaries.top_repos(page_hits(spark, sf_dir)),
    "conversation_hits": turn_hits,
    "conversation_summary_lines": lambda spark, sf_dir: reports.summary_lines(turn_hits(spark, sf_dir)),
    "diff_counts": _on_pair(reconcile.row_counts),
    "diff_equal": _on_pair(reconcile.equality),
    "same_equal": same_equal,
    "diff_rows": _on_pair(reconcile.row_differences),
    "diff_sample": _on_pair(reconcile.difference_sample),
    "diff_columns": _on_pair(reconcile.column_differences),
    "digest_diff_rows": _on_kept_pair(digests.row_differences),
    "digest_diff_columns": _on_kept_pair(digests.column_differences),
    "stored_diff_rows": _on_stored_pair(digests.stored_differences),
    "stored_diff_equal": _on_stored_pair(digests.stored_equality),
    "diff_hash": _on_hits(reconcile.fingerprint),
    "tree_repo_totals": tree_repo_totals,
    "csv_reload": csv_reload,
    "csv_sorted_reload": csv_sorted_reload,
    "tree_largest_files": tree_largest_files,
    "tree_hits": tree_hits,
    "tree_piece_totals": lambda spark, sf_dir: tree_repo_totals(spark, sf_dir, PIECE_BYTES),
    "glob_rule_table": glob_rule_table,
    "first_root_table": first_root_table,
    "tree_summary_lines": tree_summary_lines,
    "tree_skipped": tree_skipped,
    "decoded_texts": decoded_texts,
    "duplicate_paths_tiers": duplicate_paths_tiers,
    "unique_files": unique_files,
    "mixed_spelling_tiers": mixed_spelling_tiers,
    "benchmark_vocabulary_tiers": benchmark_vocabulary_tiers,
    "backslash_attribution": backslash_attribution,
    "emptied_texts": emptied_texts,
    "invalid_hint_buckets": _buckets(BROKEN_SPEC),
    "fixed_score_lines": _on_hits(lambda hits: reports.summary_lines(hits, fixed_scores=True)),
}
