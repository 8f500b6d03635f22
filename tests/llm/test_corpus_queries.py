"""The registered queries on the smallest tables: against SQL, or against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from termscan.llm import packing, queries
from termscan.llm.tokens import tokenizer_path

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection(small_dir):
    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small_dir}/{name}.parquet')")
    return connection


@pytest.fixture(scope="module")
def texts(spark, small_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, small_dir, connection, name):
    frame = queries.QUERIES[name](spark, small_dir)
    cursor = connection.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_record_digests(spark, small_dir, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path(queries.WORD_TOKENIZER))
    position = 0
    for row in sorted(queries.op3_token_records(spark, small_dir).collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 2]
        assert tuple(row) == (row["doc_id"], position, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        position += len(ids)


def test_piece_digests(spark, small_dir, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path(queries.BYTE_TOKENIZER))
    rows = queries.op6_sequence_packing(spark, small_dir).collect()
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    sequences: dict[int, list] = {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (zlib.crc32(piece.tobytes()), len(ids[r["doc_id"]])) == (r["ids_crc32"], r["doc_tokens"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(map(len, ids.values()))
    assert sum(r["length"] for r in rows) == total
    pad = 0
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        pad += packing.padding(sum(n for _, n in parts))
    assert pad < 0.03 * total


def test_shard_digests(spark, small_dir, texts):
    load = [0] * 8
    for r in queries.op7_flow_resharding(spark, small_dir).collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
    assert min(load) > 0.97 * max(load)


def test_section_tokens(spark, small_dir, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path(queries.BYTE_TOKENIZER))
    found: dict[int, list] = {}
    for r in queries.op9_section_tokens(spark, small_dir).collect():
        found.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["n_chars"], r["n_tokens"]))
    for doc_id, text in texts.items():
        ends = [b for _, b in tokenizer.encode(text, add_special_tokens=False).offsets]
        begins = [0, *ends[:-1]] if ends else []
        want, start = [], 0
        for k, line in enumerate(text.splitlines(keepends=True) or [""]):
            want.append((k, start, len(line), sum(start <= b < start + len(line) for b in begins)))
            start += len(line)
        assert sorted(found[doc_id]) == want


def test_the_other_queries_judge_every_document(spark, small_dir, texts):
    for name in ("op4_hidden_markov", "op5_quality_rules"):
        assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, small_dir).collect()) == sorted(texts)
    found = queries.op8_benchmark_leaks(spark, small_dir).collect()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    held = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    assert held and held <= {(r["doc_id"], r["item_id"]) for r in found}
