"""Texts that are already rows: any table with a path and a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_COLUMNS = ["path", "length", "text"]

# How many partitions the caller wants input tables in.  Unset, a table is read
# as its files lie, without any exchange; set it where a small table lies in
# fewer row groups than there are cores.
PARTITIONS_SETTING = "spark.termscan.inputPartitions"


def texts_as_files(table: DataFrame, path: Column, text: Column) -> DataFrame:
    """``path, length, text``, the length in UTF-8 bytes as for a file."""
    return table.select(path.alias("path"), F.octet_length(text).cast("bigint").alias("length"), text.alias("text"))


def in_partitions(files: DataFrame) -> DataFrame:
    """Spread files by path over the partitions the session asks for, if it does.

    Columns that are not used further on do not go through the exchange.
    """
    wanted = files.sparkSession.conf.get(PARTITIONS_SETTING, None)
    return files.repartition(int(wanted), "path") if wanted else files
