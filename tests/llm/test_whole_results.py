"""Operators against plain computations of their whole results, and stages with awkward columns and rows."""

from __future__ import annotations

import io
import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from termscan.llm import features, hmm, packing, quality, queries, substrings, texts, tiling, warc
from test_models import brute_tiles

# Names of results and helpers of the operators, in several spellings.
AWKWARD = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features", "log_odds", "_measured", "base_failed", "Kept", "_id", "_text",
    "_keeper", "_row", "_column_0", "_0", "_1", "_in_lang", "id", "text_key", "is_keeper", "class_id", "kept", "n_removed", "_key", "_order", "_places",
    "item_id", "_searched", "matched", "row", "start", "length", "doc_tokens", "sequence_id", "offset", "label", "quality", "_label", "_hash", "node",
]


def test_stages_pass_columns_of_any_name(spark, small_dir):
    spark.conf.set("spark.sql.caseSensitive", "false")
    names = list({n.lower(): n for n in AWKWARD}.values())
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names]).coalesce(2)
    plain = docs.drop(*names)
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, small_dir)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert rows and all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names), name
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, plain, small_dir).collect()), name
    pieces = pipeline.STAGES[-1][1](spark, docs, small_dir)
    assert pieces.groupBy("doc_id").count().count() == docs.count()


def test_equal_rows_take_time_in_proportion(spark):
    text = " ".join(f"w{i % 70}" for i in range(80))
    times = []
    for n in (500, 8000):
        docs = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
        docs = docs.unionByName(spark.createDataFrame([(1, text + " more")], "doc_id long, text string"))
        begin = time.perf_counter()
        rows = substrings.remove_repeats(docs).groupBy("doc_id", "n_removed", "kept").count().collect()
        times.append(time.perf_counter() - begin)
        assert sorted((r["doc_id"], r["n_removed"], r["kept"], r["count"]) for r in rows) == [(1, 0, text + " more", 1), (7, 80, "", n)]
    assert times[1] < 10 * times[0] + 10


def test_words_of_a_chunk_are_joined_by_one_space():
    column = pa.array(["", None, " a  b\tc ", "d", "  ", "é\n\n日本 x", "end "])
    for limit in (1, 4, 1000):
        found = pa.concat_arrays([chunk.joined() for chunk in texts.chunks(column, limit)]).to_pylist()
        assert found == [" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in column.to_pylist()]


def test_archives_cut_anywhere_raise(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 20) for i in range(3)]
    member = [warc.encode_record(dict(record_id=i, url=u, payload=p.encode(), digest="00" * 20, record_type="response", refers_to=None), "d") for i, u, p in rows]
    whole = b"".join(member)
    ends = set(itertools.accumulate(map(len, member)))
    for cut in range(1, len(whole)):
        if cut in ends:
            continue  # whole members: the manifest tells
        with pytest.raises(ValueError):
            list(warc.parse_members(io.BytesIO(whole[:cut])))
    many = spark.range(40).select(F.col("id").alias("record_id"), F.lit("http://x/").alias("url"), F.concat(F.lit("page "), "id").alias("payload"))
    manifest = warc.write_archives(many, f"file://{tmp_path}/a")
    assert warc.read_archives(manifest).count() == 40
    entry = manifest.orderBy(F.desc("records")).first()
    assert entry["records"] > 1
    path = tmp_path / "a" / entry["file"]
    data = path.read_bytes()
    path.write_bytes(data[: data.index(b"\x1f\x8b\x08", 1)])  # a whole number of members
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(manifest).collect()
    path.write_bytes(data)
    wrong = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(wrong).collect()


@pytest.mark.parametrize("length", [9, 17, 33])
def test_short_texts_leave_little_padding(length):
    plan = packing.plan_packing({length: 50_000}, 1024)
    assert 50_000 * length / (plan.sequences * 1024) > 0.97


def test_mixed_lengths_leave_little_padding():
    rng = np.random.default_rng(2)
    lengths, counts = np.unique(np.minimum(1023, rng.lognormal(4.5, 1.2, 60_000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    plan = packing.plan_packing(histogram, 1024)
    assert sum(n * c for n, c in histogram.items()) / (plan.sequences * 1024) > 0.99


@pytest.mark.parametrize("seed", range(20))
def test_greedy_patterns_cover_the_demand(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 64), rng.integers(1, 20), replace=False))
    demand = rng.integers(1, 50, len(lengths)).astype(float)
    patterns, times, exhausted = packing.greedy_patterns(lengths, demand, 64)
    assert (lengths @ patterns <= 64).all() and (times >= 0).all()
    assert np.allclose(patterns @ times, demand)
    assert np.allclose(packing.triangular_inverse(patterns, exhausted) @ patterns, np.eye(len(lengths)))


def test_contract_columns_come_first(spark, small_dir):
    want = {
        "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op6_sequence_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, small_dir).columns[: len(columns)] == columns


def test_verdicts_follow_the_trees_node_by_node(spark, small_dir):
    documents = spark.read.parquet(f"{small_dir}/documents.parquet")
    forest = quality.train_quality(documents, spark.read.parquet(f"{small_dir}/labels.parquet"))
    x = {r["doc_id"]: r["features"] for r in features.document_statistics(documents).collect()}
    depth = len(forest.value[0]).bit_length() - 1
    for row in queries.op5_quality_rules(spark, small_dir).collect():
        total = forest.base
        for feature, threshold, value in zip(forest.feature.tolist(), forest.threshold.tolist(), forest.value.tolist()):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if x[row["doc_id"]][feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        failed = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
        assert row["log_odds"] == pytest.approx(total, abs=1e-9)
        assert (row["base_failed"], row["kept"]) == (failed, not failed and total >= 0)


def test_scores_follow_a_plain_forward_recursion(spark, small_dir, monkeypatch):
    """The score of every document from the trained model and the corpus' counts, one word at a time."""
    kept = {}
    real_train, real_lexicon = hmm.train, hmm.lexicon
    monkeypatch.setattr(hmm, "train", lambda *a, **k: kept.setdefault("model", real_train(*a, **k)))
    monkeypatch.setattr(hmm, "lexicon", lambda *a, **k: kept.setdefault("lexicon", real_lexicon(*a, **k)))
    monkeypatch.setattr(hmm, "SHARED_WORDS", 900)
    monkeypatch.setattr(hmm, "OWN_WORDS", 300)
    documents = spark.read.parquet(f"{small_dir}/documents.parquet").where("length(text) < 4000")
    found = {r["doc_id"]: r for r in hmm.score_documents(documents, states=3, rounds=2).collect()}
    lexicon, model = kept["lexicon"], kept["model"]
    table = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    words_of = {}
    for i, text in table.items():
        chunk = next(texts.chunks(pa.array([text])))
        key, kind = hmm.words_of(chunk)
        words_of[i] = list(zip(key.tolist(), kind.tolist()))
    counts: dict[int, int] = {}
    for i, words in words_of.items():
        if not found[i]["held_out"]:
            for key, _ in words:
                counts[key] = counts.get(key, 0) + 1
    symbol = dict(zip(lexicon.keys.tolist(), lexicon.symbols.tolist()))
    for i, words in words_of.items():
        state, total = model.start, 0.0
        for t, (key, kind) in enumerate([*words, (None, None)]):
            own = 0 if key is None else symbol.get(key, -1)
            if own < 0:
                own = 1 + lexicon.own + kind
                total += math.log10((counts.get(key, 0) + 1) / lexicon.class_totals[kind])
            state = (state if t == 0 else state @ model.move) * model.emit[own]
            total += math.log10(state.sum())
            state = state / state.sum()
        assert found[i]["score"] == pytest.approx(total, abs=1e-6), i


def test_leaks_equal_tiling_of_all_pairs(spark, small_dir):
    documents = spark.read.parquet(f"{small_dir}/documents.parquet").where("doc_id < 120 AND length(text) < 1500")
    benchmark = spark.read.parquet(f"{small_dir}/benchmark.parquet").where("item_id < 40")
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def cut(frame, name):
        return {r[name]: word.findall((r["text"] or "").translate(lower)) for r in frame.collect()}

    items = cut(benchmark, "item_id")
    # The last document has one item in another order, the one before it too little of it.
    sample = next(w for _, w in sorted(items.items()) if len(w) >= 20)
    half = len(sample) // 2
    extra = [(900, " ".join(sample[:6]) + " other words"), (901, " ".join(sample[half:] + ["between"] + sample[:half]))]
    documents = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = set()
    for doc_id, document in cut(documents, "doc_id").items():
        for item_id, item in items.items():
            least = min(tiling.SEED, len(item))
            grams = {tuple(item[k : k + least]) for k in range(len(item) - least + 1)}
            if item and any(tuple(document[k : k + least]) in grams for k in range(len(document) - least + 1)):
                covered = brute_tiles(document, item, least)
                if 100 * covered >= tiling.COVERED_PERCENT * len(item):
                    want.add((doc_id, item_id, len(item), covered))
    found = tiling.leaks(documents, benchmark).collect()
    assert {(r["doc_id"], r["item_id"], r["item_words"], r["matched"]) for r in found} == want
    assert len(found) == len(want) and any(d == 901 for d, *_ in want)
