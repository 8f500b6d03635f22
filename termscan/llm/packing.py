"""Packing of documents into sequences by cutting-stock column generation.

Every document is cut into full pieces of the sequence length and one
remainder.  Only the histogram of remainder lengths, of fixed size, reaches
the driver: how many there are of each length.  There a linear program over
patterns (counts of lengths that fit one sequence) is solved by column
generation: from greedy patterns on, a knapsack dynamic program finds the
pattern of largest value at the current prices, a revised simplex step brings
it in.  Pattern counts are rounded down and what is left over is packed
largest first.  The plan is a list of length intervals: the k-th remainder of
a length, ranked by (doc_id, row), takes a known place in a known sequence.

Defined cases: a null or empty text is its end id alone; null ids rank first;
equal ids and repeated rows are separate documents; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.storage import numbered, stored
from termscan.llm.texts import lean
from termscan.llm.tokens import encoder, narrowed, widened

CAPACITY = 1024
# Simplex steps at most; the plan is whole at any number, only less tight.
STEPS = 300
# A pattern worth less than one sequence plus this ends the search: the linear
# program is then within this share of its optimum.
TOLERANCE = 1e-3
# Lengths are counted in classes of so many tokens: each by itself.
UNIT = 1


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths within the capacity, and its counts."""
    by_length = np.full(capacity + 1, -np.inf)
    by_length[lengths] = prices
    value = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)  # length taken to reach this size; 0: a unit left empty
    for size in range(1, capacity + 1):
        totals = by_length[1 : size + 1] + value[size - 1 :: -1]
        top = int(totals.argmax())
        if totals[top] > value[size - 1] + 1e-12:
            value[size], last[size] = totals[top], top + 1
        else:
            value[size] = value[size - 1]
    counts = np.zeros(len(lengths), np.int64)
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    size = capacity
    while size > 0:
        if last[size]:
            counts[place[last[size]]] += 1
            size -= last[size]
        else:
            size -= 1
    return float(value[capacity]), counts


def greedy_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns that fill sequences largest first, a column per length, how often each is used, and the length it exhausts.

    A pattern is used, in fractions too, until it exhausts one of its lengths;
    later ones do not hold that length.  In this order the patterns form a
    triangular matrix, and so a first basis that covers the demand exactly.
    """
    n = len(lengths)
    sizes, left = lengths.tolist(), demand.tolist()
    patterns, times, alive = np.zeros((n, n), np.int64), np.zeros(n), list(range(n - 1, -1, -1))
    exhausted = np.zeros(n, np.int64)
    for column in range(n):
        room, used = capacity, []
        for i in alive:
            if sizes[i] <= room and (left[i] > 0 or not used):
                count = min(room // sizes[i], max(1, math.ceil(left[i])))
                used.append((i, count))
                room -= count * sizes[i]
            if left[alive[0]] == 0:
                break  # exhausted by an earlier pattern: it gets one of its own that is never used
        times[column], done = min((left[i] / count, i) for i, count in used)
        for i, count in used:
            patterns[i, column] = count
            left[i] = max(0.0, left[i] - times[column] * count)
        left[done] = 0.0
        exhausted[column] = done
        alive.remove(done)
    return patterns, times, exhausted


def triangular_inverse(patterns: np.ndarray, exhausted: np.ndarray) -> np.ndarray:
    """The inverse of greedy patterns, by forward substitution in the order of exhaustion."""
    lower = patterns[exhausted].astype(float)
    solved = np.zeros_like(lower)
    for k in range(len(lower)):
        earlier = np.flatnonzero(lower[k, :k])
        solved[k] = -(lower[k, earlier, None] * solved[earlier]).sum(0)
        solved[k, k] += 1
        solved[k] /= lower[k, k]
    inverse = np.empty_like(solved)
    inverse[:, exhausted] = solved
    return inverse


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and their fractional counts that cover the demand with fewest sequences.

    Revised simplex from the greedy patterns; the basis inverse is updated in
    place.
    """
    n = len(lengths)
    basis, amount, exhausted = greedy_patterns(lengths, demand, capacity)
    inverse = triangular_inverse(basis, exhausted)
    prices = inverse.sum(0)
    for _ in range(steps):
        value, counts = best_pattern(prices, lengths, capacity)
        if value <= 1 + TOLERANCE:
            break
        used = np.flatnonzero(counts)
        entering = (inverse[:, used] * counts[used]).sum(1)
        positive = entering > 1e-9
        ratio = np.full(n, np.inf)
        ratio[positive] = amount[positive] / entering[positive]
        leaving = int(ratio.argmin())
        step = ratio[leaving]
        amount -= step * entering
        amount[leaving] = step
        np.maximum(amount, 0, out=amount)
        basis[:, leaving] = counts
        row = inverse[leaving] / entering[leaving]
        inverse -= np.outer(entering, row)
        inverse[leaving] = row
        prices = inverse.sum(0)
    return basis, amount


@dataclass(frozen=True)
class Plan:
    """Places of remainders: of ``length``, ranks ``first`` up to ``last`` go to ``sequence`` and on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_packing(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """Where each rank of each length goes; every remainder gets exactly one place."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    left = demand.copy()
    groups: list[tuple[int, list[int]]] = []  # how many sequences, the lengths in each
    if len(lengths):
        patterns, amount = column_generation(lengths, demand.astype(float), capacity, steps)
        order = np.argsort(-amount, kind="stable")
        for column in order.tolist():
            counts = patterns[:, column]
            used = np.flatnonzero(counts)
            times = int(min(np.floor(amount[column] + 1e-6), (left[used] // counts[used]).min()))
            if times > 0:
                left -= times * counts
                groups.append((times, np.repeat(lengths, counts)[::-1].tolist()))
    # What rounding leaves, largest first into the fullest sequence it fits.
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    for length, count in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        for _ in range(count):
            free = next((r for r in range(length, capacity) if room[r]), None)
            content = room[free].pop() if free is not None else []
            content.append(length)
            room[(capacity if free is None else free) - length].append(content)
    groups += [(1, content) for contents in room for content in contents]

    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, content in groups:
        offset = 0
        for length in content:
            first = taken.get(length, 0)
            rows.append((length, first, first + times, sequence, offset))
            taken[length] = first + times
            offset += length
        sequence += times
    if taken != histogram:
        raise AssertionError("the plan does not cover the histogram")
    rows.sort()
    columns = np.array(rows, np.int64).reshape(len(rows), 5).T
    return Plan(*columns, sequence)


def _cutter(path: str, words: bool, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(path, words)
        width = codes.width
        end = end_id.to_bytes(width, "little")
        names = ["doc_id", "row", "start", "length", "doc_tokens", "width", "ids"]
        kinds = [*[pa.int64()] * 5, pa.int32(), pa.binary()]
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                columns: list[list] = [[] for _ in names]
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), codes.encode(part.column(2).to_pylist()))
                for doc_id, row, ids in rows:
                    ids = narrowed(ids, width) + end
                    n = len(ids) // width
                    for start in range(0, n, capacity):
                        piece = ids[width * start : width * (start + capacity)]
                        for column, value in zip(columns, (doc_id, row, start, len(piece) // width, n, width, piece)):
                            column.append(value)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return cut


def pieces(documents: DataFrame, path: str, end_id: int, words: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces and the remainder of every document, stored once with their ids.

    ``ids`` are little-endian and unsigned, ``width`` bytes each.
    """
    table = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, row long, start long, length long, doc_tokens long, width int, ids binary"
    return stored(table.mapInArrow(lean(_cutter(path, words, end_id, capacity)), schema), "pieces")


def _placer(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        big = np.int64(1) << 48  # ranks are smaller
        starts = plan.length * big + plan.first
        for batch in batches:
            wanted = batch.column("class").to_numpy() * big + batch.column("rank").to_numpy()
            at = np.searchsorted(starts, wanted, side="right") - 1
            sequence = plan.sequence[at] + batch.column("rank").to_numpy() - plan.first[at]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("row", "start", "length")), pa.array(sequence), pa.array(plan.offset[at])],
                names=["row", "start", "length", "sequence_id", "slot"],
            )

    return place


def places(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, steps: int = STEPS) -> DataFrame:
    """``row, start, sequence_id, offset`` of stored pieces; their ids are not read.

    Lengths are rounded up to classes of ``unit`` tokens for the plan; offsets
    are those of the true lengths.  Full pieces take sequences of their own
    after those of the plan.  A sequence holds at most ``capacity`` pieces, so
    the window over it is bounded.
    """
    spark = cut.sparkSession
    size = F.ceil(F.col("length") / unit).cast("long")
    narrow = cut.select("doc_id", "row", "start", "length", size.alias("class"))
    ranked = numbered(narrow, ["class"], ["doc_id", "row", "start"], name="ranked-pieces")
    full_class = -(-capacity // unit)
    counts = ranked.groupBy("class").agg(F.count("*").alias("n")).collect()  # at most one row per class
    histogram = {row["class"]: row["n"] for row in counts if row["class"] < full_class}
    plan = plan_packing(histogram, capacity // unit, steps)
    shared = spark.sparkContext.broadcast(plan)
    schema = "row long, start long, length long, sequence_id long, slot long"
    rest = ranked.where(F.col("class") < full_class).select("row", "start", "length", "class", "rank")
    rest = rest.mapInArrow(_placer(shared), schema)
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.select("row", "start", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    full = ranked.where(F.col("class") >= full_class).select(
        "row", "start", (F.col("rank") + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return rest.unionByName(full)


def with_places(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that name a piece by (row, start)."""
    keys = placed.select(F.col("row").alias("_row"), F.col("start").alias("_start"), "sequence_id", "offset")
    return rows.join(keys, (F.col("row") == F.col("_row")) & (F.col("start") == F.col("_start"))).drop("_row", "_start")


def pack(documents: DataFrame, path: str, end_id: int, words: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset."""
    cut = pieces(documents, path, end_id, words, capacity)
    return with_places(cut, places(cut, capacity))


def digests(cut: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` (of the ids in four bytes each) in place of their ids."""
    names = ["doc_id", "row", "start", "length"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(widened(i, w)) for i, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
            columns = [*(batch.column(c) for c in names), pa.array(crc, pa.int64()), batch.column("doc_tokens")]
            yield pa.record_batch(columns, names=[*names, "ids_crc32", "doc_tokens"])

    schema = ", ".join(f"{name} long" for name in [*names, "ids_crc32", "doc_tokens"])
    return cut.mapInArrow(digest, schema)


def padding(tokens: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence that holds so many tokens: none at a power of two."""
    return 0 if tokens & (tokens - 1) == 0 else capacity - tokens
