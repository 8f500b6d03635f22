"""Text expressions: decoding, match counts and positions, line context."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: longest context, counted from the start of the line.
CONTEXT_LENGTH = 240


def match_count(folded_text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences, left to right, of a folded needle; null for an empty one."""
    removed = F.octet_length(folded_text) - F.octet_length(F.replace(folded_text, needle, F.lit("")))
    return (removed / F.nullif(F.octet_length(needle), F.lit(0))).cast("int")


def match_position(folded_text: Column, needle: Column) -> Column:
    """1-based position of the first occurrence, 0 when absent."""
    return F.instr(folded_text, needle)


def line_context(text: Column, position: Column, width: int = CONTEXT_LENGTH) -> Column:
    """The line at ``position``, cut to ``width`` from its start, white space collapsed.

    The line starts at or before ``position``, so ``width`` characters from
    there are all that can be needed.
    """
    head = F.substring_index(F.substring(text, F.lit(1), position - 1), "\n", -1)
    tail = F.substring_index(F.substring(text, position, F.lit(width)), "\n", 1)
    return tidy_line(F.concat(head, tail), width)


def tidy_line(line: Column, width: int = CONTEXT_LENGTH) -> Column:
    """The first ``width`` characters, white space collapsed."""
    return F.trim(F.regexp_replace(F.substring(line, 1, width), r"(?U)\s+", " "))


def markdown_cell(value: Column) -> Column:
    """Escape the column separator of Markdown tables."""
    return F.replace(value, F.lit("|"), F.lit("\\|"))


@contextmanager
def _replace_malformed(spark: SparkSession) -> Iterator[None]:
    """Let ``decode`` put U+FFFD for bad input while expressions are built.

    The setting is read when the expression is created, not when it runs.
    """
    key = "spark.sql.legacy.codingErrorAction"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace the binary ``content`` column by ``text``.

    UTF-8 by default, UTF-16 and UTF-32 when a byte order mark says so; the
    mark is dropped and malformed input becomes U+FFFD, never an error.
    """
    data = F.col(content)
    mark = F.hex(F.substring(data, 1, 4))
    # Longest marks first: the UTF-32 LE mark starts with the UTF-16 LE one.
    marked = [("FFFE0000", "UTF-32"), ("0000FEFF", "UTF-32"), ("FFFE", "UTF-16"), ("FEFF", "UTF-16")]
    text = F
    with _replace_malformed(files.sparkSession):
        for prefix, charset in marked:
            text = text.when(F.startswith(mark, F.lit(prefix)), F.decode(data, charset))
        text = text.otherwise(F.make_valid_utf8(data.cast("string")))
        named = files.withColumn("text", F.regexp_replace(text, "^﻿", ""))
        return named.drop(content)
