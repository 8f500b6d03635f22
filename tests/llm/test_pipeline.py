"""The stages against their operators' definitions, and the whole on the small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline as pipeline


def test_queries_are_registered():
    names = entry_module.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and [name for name, _ in pipeline.STAGES][-1] == "packing"


@pytest.fixture(scope="module")
def kept(spark, small_dir, tmp_path_factory):
    """What each stage keeps, stored."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_stages_keep_the_columns(kept):
    columns = kept["documents"].columns
    for name, _ in pipeline.STAGES[:-1]:
        assert kept[name].columns == columns


def shingles(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_quality_keeps_the_good(spark, small_dir, kept):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    good = set(rows(kept["quality"]))
    told = [(labels[i], i in good) for i in rows(kept["documents"]) if labels.get(i) is not None]
    assert sum(q == k for q, k in told) >= 0.95 * len(told)


def test_one_document_of_each_class_stays(kept):
    before, after = rows(kept["quality"]), rows(kept["near_duplicates"])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    ids = sorted(after)
    assert not any(similar(sets[a], sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b])
    # whatever went is tied to something smaller, in the end to what stays
    for i in set(before) - set(after):
        assert any(similar(sets[i], sets[j]) for j in before if j != i)
    assert all(tuple(after[i]) == tuple(before[i]) for i in ids)


def test_repeated_windows_are_cut(kept):
    before, after = rows(kept["near_duplicates"]), rows(kept["substrings"])
    seen: set = set()
    for i in sorted(before):
        words = before[i]["text"].split()
        windows = [tuple(words[a : a + 50]) for a in range(len(words) - 49)]
        gone = {a + k for a, w in enumerate(windows) if w in seen for k in range(50)}
        seen.update(windows)
        if not gone:
            assert tuple(after[i]) == tuple(before[i])
        elif len(gone) < len(words):
            text = " ".join(w for k, w in enumerate(words) if k not in gone)
            assert after[i]["text"] == text and after[i]["n_chars"] == len(text)
        else:
            assert i not in after


def test_clean_documents_pass_decontamination(spark, small_dir, kept):
    items = [r["text"] for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    before, after = rows(kept["substrings"]), rows(kept["decontamination"])
    holds = {i for i, r in before.items() if any(t in r["text"] for t in items)}
    assert holds and not holds & set(after)
    assert len(before) - len(after) < 2 * len(holds) + 5


def test_sequences_hold_every_document(kept):
    pieces = kept["packing"]
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("tokens"))
    assert whole.where("n <> tokens").count() == 0
    assert whole.count() == kept["decontamination"].count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_repeated_and_empty_rows(spark, small_dir, no_documents):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11)] * 3 + [(None, None, "en", "s", 0), (None, "x y z", "en", "s", 5), (1, "other words here", "en", "s", 16)],
        spark.read.parquet(f"{small_dir}/documents.parquet").schema,
    )
    kept = pipeline.near_duplicates(spark, docs, small_dir).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept) == sorted(
        map(repr, [(1, "a b c d e f"), (None, None), (None, "x y z"), (1, "other words here")])
    )
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), small_dir).count() == 0, name


def test_one_document_stays_where_ids_repeat(spark, small_dir):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "x"])
    other = " ".join(f"v{i}" for i in range(100))
    schema = spark.read.parquet(f"{small_dir}/documents.parquet").schema
    def stay(*pairs):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], schema)
        return sorted((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, small_dir).collect())

    assert stay((3, " ".join(words)), (5, near), (5, other)) == [(3, " ".join(words)), (5, other)]
    assert len(stay((5, " ".join(words)), (5, near), (5, "  ".join(words)))) == 1
