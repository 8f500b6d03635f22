"""A corpus made ready for training: stages over the documents table.

Each stage works on all that its predecessor kept and takes
(spark, docs, sf_dir).  All but the last return the columns of ``documents``;
the last returns pieces of documents in training sequences.  Other columns
pass through unchanged, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm import neardup, packing, quality, substrings, tiling
from termscan.llm.queries import BYTE_TOKENIZER, table
from termscan.llm.storage import shared_path, ship_package
from termscan.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Boosted trees, Bayesian pruning and column generation have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees.

    Null and empty texts have no words and go; equal rows are judged alike.
    """
    ship_package(spark)
    return quality.kept_documents(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest doc_id and then text key, once.

    Texts without words are classes of their own, each once; null ids come after all others.
    """
    ship_package(spark)
    return neardup.one_of_each_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of earlier documents; what nothing is left of goes.

    Texts without words, and those shorter than a window, stay as they are;
    ``n_chars`` follows the text where it changes.
    """
    ship_package(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substrings.remove_repeats(docs.select("doc_id", "text", *[F.col(c).alias(f"_in_{c}") for c in others]), carry=[f"_in_{c}" for c in others])
    changed = F.col("n_removed") > 0
    values = {c: F.col(f"_in_{c}") for c in others} | {
        "doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept")).otherwise(F.col("text")),
    }
    if "n_chars" in others:
        values["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(values["n_chars"])
    return cut.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(*[values[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; an empty benchmark leaves all documents.
    """
    ship_package(spark)
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, in sequences of 1024 tokens.

    A null or empty text is its end id alone; equal rows are documents of their own.
    """
    ship_package(spark)
    return packing.pack(docs, tokenizer_path(BYTE_TOKENIZER), end_id=0).drop("row")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substrings", substring_dedup),
    ("decontamination", decontamination),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
