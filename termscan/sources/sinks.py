"""Where results go: hit tables, Markdown reports, durable intermediates."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.operators import digests
from termscan.operators.reconcile import HIT_COLUMNS


def _titled(hits: DataFrame) -> DataFrame:
    return hits.select(*[F.col(c).alias(c.capitalize()) for c in HIT_COLUMNS])


MANIFEST = "_manifest.json"
# Rows that one task writes to files of their own.
TASK_FILES = 20_000
# The folder of a missing value, as Spark names it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class _Folder:
    """A result folder, and what lies beside it while it is replaced."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def beside(self, kind: str) -> object:
        # Spark passes over names that start with "_".
        return self.jvm.org.apache.hadoop.fs.Path(self.path.getParent(), f"_{kind}-{self.path.getName()}")

    def move(self, source: object, target: object) -> None:
        if not self.system.rename(source, target):
            raise OSError(f"{source} could not be renamed to {target}")

    def remove(self, path: object) -> None:
        self.system.delete(path, True)

    def files(self, path: object) -> dict[str, int]:
        found = {}
        listing = self.system.listFiles(path, True)
        while listing.hasNext():
            status = listing.next()
            name = status.getPath().toUri().getPath().removeprefix(path.toUri().getPath().rstrip("/") + "/")
            if name.rsplit("/", 1)[-1][0] not in "._":
                found[name] = status.getLen()
        return found

    def write_manifest(self, path: object) -> None:
        stream = self.system.create(self.jvm.org.apache.hadoop.fs.Path(path, MANIFEST), True)
        try:
            stream.write(bytearray(json.dumps(self.files(path), sort_keys=True).encode()))
        finally:
            stream.close()

    def is_whole(self, path: object) -> bool:
        """Whether a folder holds just the files of its manifest."""
        manifest = self.jvm.org.apache.hadoop.fs.Path(path, MANIFEST)
        if not self.system.exists(manifest):
            return False
        stream = self.system.open(manifest)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text) == self.files(path)
        except ValueError:  # the manifest itself was cut
            return False


def finish_replacing(spark: SparkSession, path: str) -> None:
    """Bring a folder to a whole state after a driver was lost in :func:`replaced`.

    The new result takes its place if it had been written whole; else the
    former one is put back.  Without leftovers nothing happens.
    """
    folder = _Folder(spark, path)
    new, old = folder.beside("new"), folder.beside("old")
    if not folder.system.exists(folder.path):
        if folder.system.exists(new) and folder.is_whole(new):
            folder.move(new, folder.path)
        elif folder.system.exists(old):
            folder.move(old, folder.path)
    for left in (new, old):
        if folder.system.exists(left):
            folder.remove(left)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` write a folder, then put it in the place of ``path``.

    The job writes to a folder beside ``path``; a manifest of its files follows,
    then two renames.  A job that fails leaves the former result as it was, and
    what reads ``path`` meanwhile, the job itself included, finds it whole.
    Between the renames there is no ``path`` for a moment; a driver lost just
    then is made good by the next call.  Where a rename copies, as in object
    stores, that moment is as long as the copy.  One writer per path at a time.
    """
    finish_replacing(spark, path)
    folder = _Folder(spark, path)
    new, old = folder.beside("new"), folder.beside("old")
    try:
        write(new.toString())
        folder.write_manifest(new)
    except BaseException:
        if folder.system.exists(new):
            folder.remove(new)
        raise
    there = folder.system.exists(folder.path)
    if there:
        folder.move(folder.path, old)
    try:
        folder.move(new, folder.path)
    except BaseException:
        finish_replacing(spark, path)
        raise
    if there:
        folder.remove(old)


def write_hits_csv(hits: DataFrame, path: str) -> None:
    """CSV with every value quoted and quotes doubled."""
    writer = _titled(hits).write.option("header", True)
    writer = writer.option("quoteAll", True).option("escape", '"').option("emptyValue", "")
    replaced(hits.sparkSession, path, writer.csv)


def write_hits_csv_sorted(hits: DataFrame, path: str) -> None:
    """CSV quoted where needed, rows by term and repository over the part files."""
    rows = hits.orderBy("term", "repo", "file")
    writer = _titled(rows).write.option("header", True).option("escape", '"').option("emptyValue", "")
    replaced(hits.sparkSession, path, writer.csv)


def write_hits(hits: DataFrame, path: str) -> DataFrame:
    """Parquet, the default form; returns the stored table."""
    replaced(hits.sparkSession, path, hits.write.parquet)
    return hits.sparkSession.read.schema(hits.schema).parquet(path)


def write_hits_with_digests(hits: DataFrame, path: str) -> None:
    """The form that ``digests.stored_equality`` and ``digests.stored_differences`` compare."""
    replaced(hits.sparkSession, path, lambda new: digests.store(hits, new))


def write_lines(lines: DataFrame, path: str) -> None:
    """A (line_no, line) report as one text file; reports are short by design."""
    ordered = lines.coalesce(1).sortWithinPartitions("line_no")
    replaced(lines.sparkSession, path, ordered.select("line").write.text)


def _file_writer(path: str, by: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        # What Spark escapes in names of folders.
        unsafe = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
        system, top = fs.FileSystem.from_uri(path)
        mine = f".{uuid.uuid4().hex}"
        current, folder, stream, files = None, "", None, 0

        def finish() -> None:
            # Attempts of a task write the same file, each its own until it is whole.
            stream.close()
            system.move(f"{folder}/{mine}", f"{folder}/part-00000.txt")

        for batch in batches:
            values = [batch.column(c).to_pylist() for c in by]
            for *place, text in zip(*values, batch.column("text").cast(pa.binary()).to_pylist()):
                if place != current:
                    if stream is not None:
                        finish()
                    parts = [f"{name.translate(unsafe)}={value.translate(unsafe)}" for name, value in zip(by, place)]
                    current, folder, files = place, "/".join([top.rstrip("/"), *parts]), files + 1
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(f"{folder}/{mine}")
                stream.write((text or b"") + b"\n")
        if stream is not None:
            finish()
        yield pa.record_batch([pa.array([files], pa.int64())], ["files"])

    return write


def write_text_tree(lines: DataFrame, path: str, by: Sequence[str]) -> int:
    """Write the column ``text`` as lines, those with equal ``by`` to one file; returns the number of files.

    The folders are those of Spark's partitioned text writer (``/a=../b=../part-*``).
    That one opens each file through Hadoop and renames folders one by one in
    the driver, which takes longer than the texts where files are many and
    small.  Here a file is put in its place by the task that wrote it.
    """
    folder = _Folder(lines.sparkSession, path)
    folder.system.mkdirs(folder.path)
    named = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias(c) for c in by]
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // TASK_FILES))
    spread = lines.select(*named, "text").repartition(int(tasks), *by).sortWithinPartitions(*by)
    return spread.mapInArrow(_file_writer(path, by), "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return tempfile.mkdtemp(prefix="termscan-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return the stored table.

    Cuts lineage in a way that outlives executors and keeps column pruning.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
