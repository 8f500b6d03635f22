"""WARC archives and resharded layouts."""

from __future__ import annotations

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from termscan.llm import resharding, storage, warc
from termscan.llm.queries import op7_flow_resharding

BIG = "<p>" + "x" * 1200
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://b", "small"), (5, "http://b", "small"),
    (6, "http://é/\r\nX: y", None), (7, "", ""), (None, "http://n", BIG), (9, "http://c", "<b>" + "é" * 3000), (9, "http://c", "<b>" + "é" * 3000),
    (8, "u", "long " * 60000),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, p, "clash", "clash") for i, u, p in PAGES]
    return spark.createDataFrame(rows, "record_id long, url string, payload string, digest string, refers_to string")


def test_archives_round_trip(pages, tmp_path):
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", roll_bytes=2000)
    rows = warc.read_archives(manifest).collect()
    got = sorted((repr(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    largest = {}
    for i, _, p in PAGES:
        if i is not None:
            largest[p] = max(i, largest.get(p, i))
    want = []
    for i, _, p in PAGES:
        data = (p or "").encode()
        revisit = len(data) >= 1000 and sum(q == p for _, _, q in PAGES) > 1 and i != largest[p]
        want.append((repr(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[p] if revisit else None))
    assert got == sorted(want)
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_archives_are_the_same_again(pages, tmp_path):
    def digests(name, rows):
        warc.write_archives(rows, f"file://{tmp_path}/{name}", roll_bytes=2000)
        return {p.name: hashlib.sha1(p.read_bytes()).hexdigest() for p in (tmp_path / name).glob("*.warc.gz")}

    assert digests("a", pages) == digests("b", pages)
    assert not list(tmp_path.glob("*/.part*.warc.gz-*"))


def test_archive_of_nothing(pages, tmp_path):
    manifest = warc.write_archives(pages.limit(0), f"file://{tmp_path}/w")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_damaged_archives_are_found():
    row = {"record_id": 1, "url": "u", "payload": b"abc", "digest": hashlib.sha1(b"abc").hexdigest(), "record_type": "response", "refers_to": None}
    packed = warc.encode_record(row, "2024-01-01T00:00:00Z")
    member = next(warc.parse_members(io.BytesIO(packed)))
    assert warc.decode_record(member)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.decode_record(member.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.parse_members(io.BytesIO(packed[:-12])))


def test_numbered_is_gapless(spark):
    rows = [(i % 3 if i % 2 else 0, i % 7, i) for i in range(300)] + [(None, 1, 1)]
    got = storage.numbered(spark.createDataFrame(rows, "g int, o int, v long"), ["g"], ["o", "v"], F.col("v")).collect()
    for g in (None, 0, 1, 2):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [(r["o"], r["v"]) for r in own] == sorted((r["o"], r["v"]) for r in own)
        assert [r["before"] for r in own] == [sum(r["v"] for r in own[:k]) for k in range(len(own))]


def brute_cost(supply, capacity, cost):
    """Cheapest placement of unit after unit, tried exhaustively."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]

    def place(k, room):
        if k == len(units):
            return 0
        return min(cost[units[k]][j] + place(k + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(len(room)) if room[j])

    return place(0, tuple(capacity))


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(25):
        supply = [rng.randint(0, 3) for _ in range(3)]
        capacity = [3, 3, 3]
        cost = [[rng.randint(0, 4) for _ in range(3)] for _ in range(3)]
        flow = resharding.minimum_cost_flow(supply, capacity, cost)
        assert [sum(row) for row in flow] == supply
        assert all(sum(row[j] for row in flow) <= capacity[j] for j in range(3))
        assert sum(f * c for fs, cs in zip(flow, cost) for f, c in zip(fs, cs)) == brute_cost(supply, capacity, cost)
    with pytest.raises(ValueError):
        resharding.minimum_cost_flow([2], [1], [[0]])


def test_plans_are_even_and_move_little():
    rng = random.Random(2)
    sizes = {b: rng.randint(1, 5000) for b in range(400)}
    old = {b: b % 5 for b in sizes}
    new = resharding.plan_moves(sizes, old, 8)
    load = [sum(s for b, s in sizes.items() if new[b] == j) for j in range(8)]
    moved = sum(s for b, s in sizes.items() if new[b] != old[b]) / sum(sizes.values())
    assert min(load) > 0.99 * max(load) and moved < 0.42
    assert resharding.plan_moves({}, {}, 8) == {}


def test_only_files_of_moved_blocks_are_written(spark, odd_documents, odd_texts, no_documents):
    layout, sizes = resharding.write_layout(odd_documents, 2, blocks=16)
    after = resharding.reshard(spark, layout, sizes, 3)
    (old, kept), (new, moved) = after.folders.items()
    assert not set(kept) & set(moved) and set(kept) | set(moved) == set(sizes)
    assert all(layout.shard_of[b] == after.shard_of[b] for b in kept)
    assert {r["block"] for r in spark.read.parquet(new).select("block").distinct().collect()} == set(moved)
    rows = after.read(spark).collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in rows])) == sorted(map(repr, odd_texts))
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    empty, none = resharding.write_layout(no_documents, 2)
    assert resharding.reshard(spark, empty, none, 3).read(spark).count() == 0


@pytest.mark.parametrize("same_id", [False, True])
def test_shards_are_even_with_a_third_of_the_rows_equal(spark, same_id):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices("abcdefgh", k=300))) for i in range(2400)]
    copies = [(7 if same_id else 9000 + i, "copied " * 85) for i in range(1200)]
    table = spark.createDataFrame(texts + copies, "doc_id long, text string").repartition(4)
    layout, sizes = resharding.write_layout(table, 5)
    rows = resharding.reshard(spark, layout, sizes, 8).read(spark).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(texts + copies)
    load = [sum(len(r["text"]) + 1 for r in rows if r["shard"] == j) for j in range(8)]
    assert min(load) > 0.97 * max(load), load


def test_slots_are_gapless(spark, small_dir):
    rows = op7_flow_resharding(spark, small_dir).collect()
    for shard in range(8):
        own = [r["slot"] for r in rows if r["shard"] == shard]
        assert sorted(own) == list(range(len(own)))
    assert len(rows) == spark.read.parquet(f"{small_dir}/documents.parquet").count()
