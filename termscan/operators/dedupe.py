"""Files reached more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.functions.paths import is_below


def files_per_root(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Files once per root they lie under, with ``root_id``: duplicates kept.

    One pass over ``files``: the matching roots become an array per row.
    """
    ids = F.array_compact(F.array(*[
        F.when(is_below(F.col("path"), root), F.lit(root_id))
        for root_id, root in enumerate(roots)
    ]))
    return files.withColumn("root_id", F.explode(ids))


def distinct_roots(roots: Sequence[str]) -> list[str]:
    """Roots that are not inside another listed root, in the order given.

    Reading only these lists every file once, so nothing has to be removed
    from the data afterwards.  Roots are compared letter by letter: names that
    differ in case are different directories on most stores.
    """
    def stem(root: str) -> str:
        return root.replace("\\", "/").rstrip("/")

    kept: list[str] = []
    for root in roots:
        inside = any(stem(root).startswith(stem(other) + "/") for other in roots)
        if not inside and stem(root) not in map(stem, kept):
            kept.append(root)
    return kept


def distinct_files(files: DataFrame, order: Sequence[str] = ("path",)) -> DataFrame:
    """One row per path, any case: the first by ``order``, then by the other columns.

    A single aggregation with partial results; exact copies collapse to one
    row.  All columns of ``files`` go through it, so select what is needed
    first; :func:`repeated_paths` serves tables that carry texts.
    """
    rest = [c for c in files.columns if c not in order]
    first = files.groupBy(F.lower("path").alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) for c in files.columns])


def repeated_paths(files: DataFrame) -> DataFrame:
    """``path_key, first_path, first_text`` of paths that occur more than once, any case.

    The row that stays is the first by path and hash of its text; texts
    themselves are not exchanged, and without repeated paths the table is
    empty.
    """
    first = F.min(F.struct("path", F.xxhash64("text").alias("text_key")))
    counted = files.groupBy(F.lower("path").alias("path_key")).agg(F.count("*").alias("copies"), first.alias("first"))
    repeated = counted.where("copies > 1")
    return repeated.select("path_key", F.col("first.path").alias("first_path"), F.col("first.text_key").alias("first_text"))
