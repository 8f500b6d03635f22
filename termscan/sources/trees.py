"""File trees, ignore-rule files and hit tables on disk."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.functions.paths import expand_env, normalize_extensions, without_scheme
from termscan.functions.patterns import ignore_case, is_blank
from termscan.functions.text import with_text
from termscan.operators.dedupe import distinct_roots
from termscan.sources import walk

# Column order and header of the hit table on disk.
HIT_FILE_SCHEMA = (
    "Term string, Repo string, File string, Ext string, Bucket string, Frequency int, Context string"
)

# A longer file does not fit one value; it is reported as skipped.
MAX_VALUE_BYTES = 2**31 - 1
MISSING_ROOT, TOO_LONG = "missing root", "too long for one value"


def existing_roots(spark: SparkSession, roots: Iterable[str]) -> list[str]:
    """Expanded roots that exist; see :func:`missing_roots` for the others."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(root: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(conf).exists(path)

    return [root for root in map(expand_env, roots) if not is_blank(root) and exists(root)]


def missing_roots(roots: Iterable[str], found: Sequence[str]) -> list[str]:
    """Expanded roots that are not among those found."""
    return [root for root in map(expand_env, roots) if not is_blank(root) and root not in found]


def _any_case_glob(extensions: Sequence[str]) -> str:
    """``*.{[mM][dD],...}``: the extension list as a listing filter."""
    def letters(name: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)

    return "*.{" + ",".join(letters(e.lstrip(".")) for e in extensions) + "}"


def list_tree(
    spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = (), dedupe: bool = True
) -> DataFrame:
    """``path, length, modification_time, content`` of all files below the roots.

    Unselected columns are not read: without ``content`` no file is opened.
    With ``dedupe`` nested roots are listed once; otherwise a file appears once
    per root above it.  A file that cannot be read fails the task that reads it.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
    )
    plain = [e for e in normalize_extensions(extensions) if e[1:].isalnum()]
    if plain and len(plain) == len(normalize_extensions(extensions)):
        reader = reader.option("pathGlobFilter", _any_case_glob(plain))
    found = existing_roots(spark, roots)
    if not found:
        schema = "path string, length bigint, modification_time timestamp, content binary"
        return spark.createDataFrame([], schema)
    if dedupe:
        listed = reader.load(distinct_roots(found))
    else:
        listed = reader.load(found[0])
        for root in found[1:]:
            listed = listed.unionByName(reader.load(root))
    return listed.select(
        without_scheme(F.col("path")).alias("path"),
        "length",
        F.col("modificationTime").alias("modification_time"),
        "content",
    )


def read_tree(
    spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = (), dedupe: bool = True
) -> DataFrame:
    """Files with decoded ``text``.

    A file too long for one value is skipped; the predicate reaches the source,
    so it is not opened.  See :func:`left_out` for these.
    """
    listed = list_tree(spark, roots, extensions, dedupe)
    return with_text(listed.where(F.col("length") <= MAX_VALUE_BYTES))


def left_out(spark: SparkSession, roots: Sequence[str], listing: DataFrame) -> DataFrame:
    """``path, reason`` of missing roots and of files of a (filtered) listing that are too long; none is opened."""
    missing = missing_roots(roots, existing_roots(spark, roots))
    table = spark.createDataFrame([(root, MISSING_ROOT) for root in missing], "path string, reason string")
    long = listing.where(F.col("length") > MAX_VALUE_BYTES).select("path", F.lit(TOO_LONG).alias("reason"))
    return table.withColumn("path", without_scheme(F.col("path"))).unionByName(long)


def walk_everything(
    spark: SparkSession, roots: Sequence[str], prune_dir_regex: str | None = None, dedupe: bool = True
) -> DataFrame:
    """``path, root, name, length, modification_time, skipped`` of all files, hidden names included.

    Directories whose path matches ``prune_dir_regex`` are not entered.  Rows
    with a reason in ``skipped`` are roots and directories that could not be
    listed.
    """
    def enter(directories: DataFrame) -> DataFrame:
        if is_blank(prune_dir_regex):
            return directories
        return directories.where(~F.rlike(without_scheme(F.col("path")), F.lit(ignore_case(prune_dir_regex))))

    found = existing_roots(spark, roots)
    missing = missing_roots(roots, found)
    schema = "root string, name string, path string, length bigint, modification_time timestamp, skipped string"
    listed = spark.createDataFrame([(root, None, root, 0, None, MISSING_ROOT) for root in missing], schema)
    groups = [distinct_roots(found)] if dedupe else [[root] for root in found]
    for group in groups:
        if group:
            listed = listed.unionByName(walk.walk(spark, group, enter))
    return listed.withColumn("path", without_scheme(F.col("path")))


def walk_tree(
    spark: SparkSession, roots: Sequence[str], prune_dir_regex: str | None = None, dedupe: bool = True
) -> DataFrame:
    """The files of :func:`walk_everything`."""
    return walk_everything(spark, roots, prune_dir_regex, dedupe).where("skipped IS NULL").drop("skipped")


def read_or_skipped(listing: DataFrame, longest: int | None = None) -> DataFrame:
    """Files of a (filtered) listing with decoded ``text``, or without it and with the reason in ``skipped``.

    Every file is opened once.  Files that are gone or must not be read, and
    those longer than ``longest`` bytes (what fits one value, if not given),
    have a reason; any other failure fails the task.
    """
    fits = F.col("length") <= (MAX_VALUE_BYTES if longest is None else longest)
    read = with_text(walk.read_contents(listing.where(fits)))
    long = listing.where(~fits).select("path", "length", "modification_time", F.lit(None).cast("string").alias("text"), F.lit(TOO_LONG).alias("skipped"))
    return read.unionByName(long)


def read_pieces(listing: DataFrame, piece_bytes: int, reach: int) -> DataFrame:
    """``path, piece, text, ahead, skipped`` of a listing's files in pieces of about ``piece_bytes``.

    ``ahead`` holds at least ``reach`` of the characters that follow a piece,
    if there are as many, and so does every piece but the last of a file.
    """
    ahead = 4 * (reach + 1) + walk.CUT_SLACK
    pieces = walk.read_pieces(listing, max(piece_bytes // 4 * 4, ahead), ahead)
    named = with_text(pieces, "ahead").withColumnRenamed("text", "ahead")
    return with_text(named)


def read_listed(listing: DataFrame) -> DataFrame:
    """Only the files that could be read, with decoded ``text``."""
    return read_or_skipped(listing).where("skipped IS NULL").drop("skipped")


def unlisted(everything: DataFrame) -> DataFrame:
    """``path, reason`` of roots and directories that could not be listed."""
    return everything.where("skipped IS NOT NULL").select("path", F.col("skipped").alias("reason"))


def rule_lines(
    spark: SparkSession,
    patterns: Sequence[str],
    rule_files: Sequence[str] = (),
    roots: Sequence[str] = (),
    ignore_file_name: str = ".scanignore",
) -> list[str]:
    """Ignore lines in effect order: configured, listed files, one file per root.

    Rule files are configuration of a few lines.  Missing ones are skipped, and
    so are, with a warning, those that cannot be read.
    """
    lines = list(patterns)
    per_root = [root.rstrip("/\\") + "/" + ignore_file_name for root in roots]
    # Read through the file system: the file source skips names with a leading dot.
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in [*map(expand_env, rule_files), *per_root]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(conf)
        if not system.exists(path):
            continue
        try:
            stream = system.open(path)
            try:
                content = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as problem:
            warnings.warn(f"rule file {name} is not used: {problem.java_exception}", stacklevel=2)
            continue
        lines += content.removeprefix("\ufeff").splitlines()
    return lines


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table written as CSV, with this engine's column names.

    A hit row has no nulls: a value that reads as missing was an empty string.
    """
    table = (
        spark.read.schema(HIT_FILE_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    return table.select(*[
        (F.coalesce(F.col(name), F.lit("")) if kind == "string" else F.col(name)).alias(name.lower())
        for name, kind in table.dtypes
    ])
