"""Tables and files in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.sources.sinks import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back: cuts the lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_READERS = 10_000

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the functions that run in tasks."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="termscan-")) / "termscan.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new shared folder, as an address with its scheme."""
    path = new_folder(spark, name)
    return path if ":" in path.split("/")[0] else f"file://{path}"


def write_atomically(folder: str, name: str, produce) -> None:
    """Write a file under a temporary name, then rename it.

    ``produce`` gets the open binary stream.  A repeated task writes the same
    bytes under the same final name, so a lost or doubled attempt does no harm.
    """
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(folder)
    system.create_dir(top, recursive=True)
    temporary = f"{top}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as stream:
        produce(stream)
    system.move(temporary, f"{top}/{name}")


def open_input(folder: str, name: str):
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{top}/{name}")


def spread_by_file(rows: DataFrame, file: str, *order: str) -> DataFrame:
    """Rows that name a file, a task per file up to ``MOST_READERS``.

    The rows are small and the files are not, so the number of tasks is given:
    left to itself, adaptive execution would put all of them into one.
    """
    files = rows.select(file).distinct().count()
    return rows.repartition(max(1, min(files, MOST_READERS)), file).sortWithinPartitions(file, *order)


def numbered(df: DataFrame, group: list[str], order: list[str], weight: Column | None = None, name: str = "ranked") -> DataFrame:
    """Add ``rank``: rows of the same group before this one, by ``order``, from 0.

    With ``weight`` also ``before``: the sum of their weights.  ``df`` should be
    narrow: it is range-sorted and stored once.  A group of any size is spread
    over many tasks; only counts per (group, task) are put in order.
    """
    keys = [*group, *order]
    source = df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    ordered = source.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = stored(ordered.withColumn("_row", F.monotonically_increasing_id()), name)
    task = F.shiftright("_row", 33)
    from pyspark.sql import Window

    counts = table.groupBy(*group, task.alias("_task")).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first"), F.sum("_weight").alias("_sum")
    )
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_task").alias("_t"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    joined = table.join(counts, [*same, task == F.col("_t")])
    out = joined.withColumn("rank", F.col("_rank0") + F.col("_row") - F.col("_first"))
    if weight is not None:
        within = Window.partitionBy(*group, task).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_sum0") + F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return out.select(*df.columns, "rank", *(["before"] if weight is not None else []))
