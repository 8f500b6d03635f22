"""Quality rules: boosted trees over document statistics.

``train_quality`` fits on a sample of labelled documents, bounded by
``SAMPLE_ROWS``: the labels with the smallest hash of their id.  Of documents
that share an id the one with the smallest hash of its text stands for all, so
that no more rows of features reach the driver.  ``judge`` scores every document where it is
read, with the forest as flat arrays.

Defined cases: labels without an id or value are left out; without labels of
both kinds every document that passes the base rules is kept; null and empty
texts have no words and fail the base rules; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.llm.boosting import Forest, train
from termscan.llm.features import COUNTS, RATIOS, document_statistics

SAMPLE_ROWS = 20_000
# More of these never makes a document better.
WORSE = ["symbol_share", "dup_line_share", "repeat_share", "mark_share", "pipe_share"]
MONOTONE = np.array([-1 if name in WORSE else 0 for name in RATIOS])
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# Log-odds of being good from which a document is kept.
CUT = 0.0


def labelled_features(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of the sample."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).dropna().distinct()
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    chosen = documents.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("_hash")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    measured = document_statistics(chosen, ["doc_id", "_label", "_hash"])
    first = measured.groupBy("doc_id", "_label").agg(F.min(F.struct("_hash", "features")).alias("first"))
    found = first.select("doc_id", "_label", "first.features").collect()
    found.sort(key=lambda row: (row["doc_id"], row["_label"], row["features"]))
    x = np.array([row["features"] for row in found], float).reshape(len(found), len(RATIOS))
    return x, np.array([row["_label"] for row in found], float)


def train_quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    x, y = labelled_features(documents, labels, rows=rows)
    return train(x, y, MONOTONE)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(documents: DataFrame, forest: Forest, carry: Sequence[str] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """``*carry``, the counts, ``base_failed``, ``kept`` and ``log_odds``.

    Carried columns must not be named like a result.
    """
    clash = {c.lower() for c in carry} & {"base_failed", "kept"}
    if clash:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    shared = documents.sparkSession.sparkContext.broadcast(forest)
    scored = document_statistics(documents, carry, shared).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("log_odds") >= cut)
    return scored.select(*carry, *COUNTS, "base_failed", kept.alias("kept"), "log_odds")


def kept_documents(documents: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, whatever their names."""
    names = [f"_column_{i}" for i in range(len(documents.columns))]
    at = [c.lower() for c in documents.columns].index("text")
    judged = judge(documents.toDF(*names).withColumn("text", F.col(names[at])), forest, names, cut)
    return judged.where("kept").select(*names).toDF(*documents.columns)
