"""Resharding by minimum-cost flow.

Rows lie in blocks by the hash of their text, so equal texts stay together,
and whole blocks lie in shards.  Equal texts that weigh more than an average
block together are dealt over all blocks, by their id and, where equal rows
alone weigh more than that, by number: no block is heavy for its copies.  From the bytes of the old shards and the
capacities of the new ones a minimum-cost flow gives how much each old shard
hands to each new one when the fewest bytes move.  Blocks, largest first, then
follow the flow, and single blocks are shifted or swapped until no such step
evens the shards further.  Only the files of blocks that move are read and
written anew; all others stay as they are.

What reaches the driver is one row per block, whose number is a parameter, and
the hashes of what is dealt, fewer than two per block.

Defined cases: a null text has no bytes and lies in the block of the empty
one; null and equal ids and repeated rows are rows like others; an empty table
gives an empty layout; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm.storage import shared_path

BLOCKS = 512
ROW_SCHEMA = "doc_id long, text string, block int"


def row_bytes(text: Column) -> Column:
    """Bytes of a row: its text and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def minimum_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Amounts from each source to each sink that place all supply at least cost.

    Successive shortest paths in the residual graph; the sinks' capacities
    must be enough together.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = float("inf")
        source_cost = [0 if left[i] else far for i in range(n)]
        sink_cost = [far] * m
        source_from = [-1] * n
        sink_from = [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if source_cost[i] + cost[i][j] < sink_cost[j]:
                        sink_cost[j], sink_from[j], changed = source_cost[i] + cost[i][j], i, True
                    if flow[i][j] and sink_cost[j] - cost[i][j] < source_cost[i]:
                        source_cost[i], source_from[i], changed = sink_cost[j] - cost[i][j], j, True
        open_sinks = [j for j in range(m) if room[j] and sink_cost[j] < far]
        if not open_sinks:
            raise ValueError("the new shards cannot hold the old ones")
        end = min(open_sinks, key=lambda j: sink_cost[j])
        path, j = [], end
        while True:
            i = sink_from[j]
            path.append((i, j))
            if source_from[i] < 0:
                break
            j = source_from[i]
        amount = min(left[path[-1][0]], room[end], *(flow[i][source_from[i]] for i, _ in path[:-1]))
        for i, j in path:
            flow[i][j] += amount
        for i, _ in path[:-1]:
            flow[i][source_from[i]] -= amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def even_out(sizes: dict[int, int], shard_of: dict[int, int], target: list[int]) -> dict[int, int]:
    """Shift or swap single blocks between the fullest and the emptiest shard while that helps."""
    shard_of = dict(shard_of)
    load = [0] * len(target)
    members: list[set[int]] = [set() for _ in target]
    for block, shard in shard_of.items():
        load[shard] += sizes[block]
        members[shard].add(block)
    for _ in range(20 * len(target) + len(sizes)):
        over = [load[j] - target[j] for j in range(len(target))]
        high, low = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[high] - over[low]
        # A step that carries d over leaves a gap of |gap - 2 d|.
        best = (gap, -1, -1)
        emptier = sorted((sizes[b], b) for b in members[low])
        for block in sorted(members[high]):
            best = min(best, (abs(gap - 2 * sizes[block]), block, -1))
            wanted = sizes[block] - gap / 2
            at = _nearest(emptier, wanted)
            if at is not None:
                best = min(best, (abs(gap - 2 * (sizes[block] - at[0])), block, at[1]))
        if best[0] >= gap:
            break
        for block, old, new in ((best[1], high, low), (best[2], low, high)):
            if block >= 0:
                members[old].remove(block)
                members[new].add(block)
                load[old] -= sizes[block]
                load[new] += sizes[block]
                shard_of[block] = new
    return shard_of


def _nearest(ordered: list[tuple[int, int]], wanted: float) -> tuple[int, int] | None:
    from bisect import bisect_left

    at = bisect_left(ordered, (wanted, -1))
    near = ordered[max(0, at - 1) : at + 1]
    return min(near, key=lambda entry: abs(entry[0] - wanted)) if near else None


def plan_moves(sizes: dict[int, int], old_shard: dict[int, int], shards: int) -> dict[int, int]:
    """The new shard of each block: equal capacities, fewest bytes moved."""
    old = 1 + max(old_shard.values(), default=0)
    supply = [0] * old
    for block, shard in old_shard.items():
        supply[shard] += sizes[block]
    total = sum(supply)
    target = [total // shards + (j < total % shards) for j in range(shards)]
    cost = [[0 if i == j else 1 for j in range(shards)] for i in range(old)]
    flow = minimum_cost_flow(supply, target, cost)
    new: dict[int, int] = {}
    for block in sorted(sizes, key=lambda b: (-sizes[b], b)):
        i = old_shard[block]
        j = max(range(shards), key=lambda j: (flow[i][j], -j))
        flow[i][j] -= sizes[block]
        new[block] = j
    return even_out(sizes, new, target)


@dataclass(frozen=True)
class Layout:
    """Folders of files by block, each with the blocks that count there, and the shard of each block."""

    folders: dict[str, list[int]]
    shard_of: dict[int, int]
    shards: int

    def read(self, spark: SparkSession) -> DataFrame:
        """``doc_id, text, block, shard``; files of blocks that lie elsewhere by now are not opened."""
        parts = [spark.read.schema(ROW_SCHEMA).parquet(folder).where(F.col("block").isin(blocks)) for folder, blocks in self.folders.items() if blocks]
        if not parts:
            return spark.createDataFrame([], ROW_SCHEMA + ", shard int")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        shards = spark.createDataFrame(sorted(self.shard_of.items()), "_block int, shard int")
        return rows.join(F.broadcast(shards), F.col("block") == F.col("_block")).drop("_block")


def heavy_groups(rows: DataFrame, share: int) -> tuple[list[int], list[int]]:
    """Hashes of equal texts, and of equal rows, that weigh more than ``share`` together and are more than one."""
    hashed = rows.select(_text_hash().alias("h"), _row_hash().alias("p"), row_bytes(F.col("text")).alias("bytes"))
    sums = hashed.groupingSets([["h"], ["h", "p"]], "h", "p").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    found = sums.where((F.col("bytes") > share) & (F.col("n") > 1)).collect()
    return sorted(r["h"] for r in found if r["p"] is None), sorted(r["p"] for r in found if r["p"] is not None)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _row_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), "doc_id")


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``doc_id, text`` with the block of each row."""
    total = rows.agg(F.sum(row_bytes(F.col("text")))).first()[0] or 0
    texts, same = heavy_groups(rows, total // blocks)
    key = F.when(_text_hash().isin(texts), _row_hash()).otherwise(_text_hash()) if texts else _text_hash()
    block = F.pmod(key, F.lit(blocks)).cast("int").alias("block")
    if not same:
        return rows.select("doc_id", "text", block)
    alike = _row_hash().isin(same)
    return rows.where(~alike).select("doc_id", "text", block).unionByName(_dealt(rows.where(alike), blocks))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Equal rows, counted and dealt evenly over all blocks; a repeated task deals them alike."""
    counted = rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    turns = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(blocks)) - 1)).alias("i"))
    block = F.pmod(F.pmod(_row_hash(), F.lit(blocks)) + F.col("i"), F.lit(blocks)).cast("int")
    copies = F.expr(f"n div {blocks}") + (F.col("i") < F.col("n") % blocks).cast("long")
    # The number of tasks is given: few rows come in, but any number of copies goes out.
    spread = turns.select("doc_id", "text", block.alias("block"), copies.alias("copies")).repartition(blocks, "block")
    return spread.select("doc_id", "text", "block", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def write_layout(documents: DataFrame, shards: int, blocks: int = BLOCKS, folder: str | None = None) -> tuple[Layout, dict[int, int]]:
    """Write rows by block, block b in shard b mod ``shards``; returns the layout and the blocks' bytes.

    A block of any size is split over several files by Spark's rebalancing.
    """
    spark = documents.sparkSession
    folder = folder or shared_path(spark, "layout")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    in_blocks(rows, blocks).hint("rebalance", "block").write.partitionBy("block").option("compression", "zstd").parquet(folder)
    stored = spark.read.schema(ROW_SCHEMA).parquet(folder)
    found = stored.groupBy("block").agg(F.sum(row_bytes(F.col("text"))).alias("bytes")).collect()
    sizes = {row["block"]: row["bytes"] for row in found}
    return Layout({folder: sorted(sizes)}, {b: b % shards for b in sizes}, shards), sizes


def reshard(spark: SparkSession, layout: Layout, sizes: dict[int, int], shards: int, folder: str | None = None) -> Layout:
    """Move blocks so that ``shards`` shards are about equal; rewrites the files of moved blocks only."""
    new = plan_moves(sizes, layout.shard_of, shards)
    moved = sorted(b for b, shard in new.items() if shard != layout.shard_of[b])
    if not moved:
        return Layout(layout.folders, new, shards)
    folder = folder or shared_path(spark, "layout")
    going = layout.read(spark).where(F.col("block").isin(moved)).drop("shard")
    going.write.partitionBy("block").option("compression", "zstd").parquet(folder)
    gone = set(moved)
    folders = {old: [b for b in blocks if b not in gone] for old, blocks in layout.folders.items()}
    return Layout(folders | {folder: moved}, new, shards)
