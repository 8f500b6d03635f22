"""Removal of word windows that a document with a smaller id also holds.

Pass 1 builds count-min sketches.  A window's sketch key is the smallest hash
of the shorter word grams inside it, which equal windows share and neighbours
mostly share too, so a few keys stand for many windows.  Each task counts the
keys of its documents in two rows of cells; the partial sketches are merged by
cell range.  A cell counts at least every document that holds a window of that
key, so a window found twice always has two counts or more in both rows: none
is lost.  The cells counted twice or more become a bitmap of bounded size.

Pass 2 takes only windows whose key has both bits set and groups them exactly
by 128 bits of their word sequence: the smallest document id of each window,
with partial sums, joined back to its places.  A window that a third of all
documents hold sends one row a task into the grouping, and its places are
split by Spark's skew join.

Defined cases: a null or empty text has no words; fewer words than the window
remove nothing; a null id counts as larger than all others; rows with equal
ids do not count against each other; repeated rows get equal results; other
columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.storage import stored
from termscan.llm.texts import WINDOW_BASES, Chunk, chunks, lean, mix, span_hashes, window_hashes, words

WINDOW = 50
ROWS = (0x243F6A8885A308D3, 0x13198A2E03707344)
# Bits of a bitmap row: eight for each repeated cell, at most 2**30 (128 MB).
MOST_BITS = 30
FLUSH_KEYS = 1 << 21
LARGEST_ID = (1 << 63) - 1

CELL_SCHEMA = "sketch int, part int, cells binary"
WINDOW_SCHEMA = "w1 long, w2 long, order_id long, key long"
PLACE_SCHEMA = WINDOW_SCHEMA + ", places binary"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Windows:
    """The windows of a chunk: their text, first word, and runs of equal sketch key."""

    def __init__(self, chunk: Chunk, size: int) -> None:
        self.size = size
        self.text, self.first = chunk.windows(size)
        self.hashes = chunk.word_hashes(0) if len(self.first) else np.zeros(0, np.uint64)
        if not len(self.first):
            self.run_start = np.zeros(0, np.int64)
            self.run_key = np.zeros(0, np.uint64)
            return
        gram = max(1, size // 2)
        smallest = sliding_minimum(window_hashes(self.hashes, gram, WINDOW_BASES[0]), size - gram + 1)
        key = smallest[self.first]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (self.text[1:] != self.text[:-1])
        self.run_start = np.flatnonzero(new)
        self.run_key = key[self.run_start]

    def marked(self, bitmaps: Sequence[bytes], bits: int) -> np.ndarray:
        """Which windows the sketch estimates to be repeated."""
        hit = np.ones(len(self.run_key), bool)
        for seed, bitmap in zip(ROWS, bitmaps):
            cell = cells(self.run_key, seed) >> np.uint32(32 - bits)
            packed = np.frombuffer(bitmap, np.uint8)
            hit &= (packed[cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1
        return np.repeat(hit, np.diff(self.run_start, append=len(self.first)))


def cells(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)


def _sketcher(size: int, part_bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sketch", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for row, seed in enumerate(ROWS):
                found, counts = np.unique(cells(keys, seed), return_counts=True)
                kept = np.repeat(found, np.minimum(counts, 2))  # a second count says: repeated
                bounds = np.searchsorted(kept, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(32 - part_bits))
                parts = [p.astype("<u4").tobytes() for p in np.split(kept, bounds)]
                full = [i for i, p in enumerate(parts) if p]
                columns = [[row] * len(full), full, [parts[i] for i in full]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(Windows(chunk, size).run_key)
                if sum(map(len, held)) > FLUSH_KEYS:
                    yield from flush()
        yield from flush()

    return sketch


def _repeated_cells(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    found = np.frombuffer(b"".join(pdf["cells"]), "<u4")
    found, counts = np.unique(found, return_counts=True)
    return pd.DataFrame({"sketch": [key[0]], "part": [key[1]], "cells": [found[counts > 1].astype("<u4").tobytes()]})


def repeated_bitmaps(texts: DataFrame, size: int) -> tuple[list[bytes], int]:
    """Bitmaps of the cells counted twice or more in the merged sketches, and their bits.

    The number of cell ranges follows ``spark.sql.shuffle.partitions``.  What
    reaches the driver is the packed bitmap, at most 2**MOST_BITS bits a row.
    """
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(14, max(6, (partitions - 1).bit_length()))
    partial = texts.mapInArrow(lean(_sketcher(size, part_bits)), CELL_SCHEMA)
    merged = stored(partial.groupBy("sketch", "part").applyInPandas(_repeated_cells, CELL_SCHEMA), "sketch")
    most = merged.groupBy("sketch").agg(F.sum(F.octet_length("cells")).alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(MOST_BITS, max(part_bits + 3, (most * 2).bit_length()))
    width = bits - part_bits

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = []
            for part, found in zip(frame["part"], frame["cells"]):
                flags = np.zeros(1 << width, bool)
                flags[(np.frombuffer(found, "<u4") >> np.uint32(32 - bits)) - np.uint32(part << width)] = True
                packed.append(np.packbits(flags).tobytes())
            yield frame.assign(cells=packed)

    empty = bytes(1 << (width - 3))
    rows: list[dict[int, bytes]] = [{} for _ in ROWS]
    for row in merged.mapInPandas(pack, CELL_SCHEMA).toLocalIterator():
        rows[row["sketch"]][row["part"]] = bytes(row["cells"])
    return [b"".join(row.get(part, empty) for part in range(1 << part_bits)) for row in rows], bits


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _order_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LARGEST_ID).to_numpy(zero_copy_only=False)


def _text_keys(chunk: Chunk, hashes: np.ndarray) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    return span_hashes(hashes, chunk.word_bounds[:-1], chunk.word_bounds[1:], WINDOW_BASES[1])


def _candidates(size: int, sketch, bits: int, places: bool):
    """Windows estimated to be repeated, once per text and, with ``places``, where they start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "order_id", "key", *(["places"] if places else [])]
        for batch in batches:
            ids = _order_ids(batch.column(0))
            for chunk in chunks(batch.column(1)):
                found = Windows(chunk, size)
                which = np.flatnonzero(found.marked(sketch.value, bits))
                if not len(which):
                    continue
                first, text = found.first[which], found.text[which]
                w1 = span_hashes(found.hashes, first, first + size, WINDOW_BASES[0])
                w2 = span_hashes(chunk.word_hashes(1), first, first + size, WINDOW_BASES[1])
                order = np.lexsort((w2, w1, text))
                w1, w2, text, first = w1[order], w2[order], text[order], first[order]
                new = np.ones(len(order), bool)  # a text that repeats itself holds a window many times
                new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                columns = [_signed(w1[at]), _signed(w2[at]), pa.array(ids[chunk.first + text[at]])]
                if places:
                    place = (first - chunk.word_bounds[:-1][text]).astype("<i4")
                    ends = (4 * np.append(at, len(order))).astype(np.int32)
                    columns.append(_signed(_text_keys(chunk, found.hashes)[text[at]]))
                    columns.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(place)]))
                else:
                    columns.append(pa.array(np.zeros(len(at), np.int64)))
                yield pa.record_batch(columns, names=names)

    return find


def _split(size: int, sketch, bits: int, marked: bool):
    """Texts with a window estimated to be repeated (``marked``), or the others, which are done."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _order_ids(batch.column(0))
            for chunk in chunks(batch.column(1)):
                found = Windows(chunk, size)
                flags = np.zeros(len(chunk), bool)
                flags[found.text[found.marked(sketch.value, bits)]] = True
                which = np.flatnonzero(flags == marked)
                if not len(which):
                    continue
                rows = batch.take(pa.array(chunk.first + which))
                if not marked:
                    kept = chunk.joined().take(pa.array(which)).cast(pa.string())
                    n_words = chunk.n_words[which].astype(np.int64)
                    yield pa.record_batch(
                        [*rows.columns, kept, pa.array(n_words), pa.array(np.zeros(len(which), np.int64))],
                        names=[*rows.schema.names, "kept", "n_words", "n_removed"],
                    )
                    continue
                hashes = found.hashes if len(found.hashes) else chunk.word_hashes(0)
                yield pa.record_batch(
                    [*rows.columns, _signed(_text_keys(chunk, hashes)[which]), pa.array(ids[chunk.first + which])],
                    names=[*rows.schema.names, "_key", "_order"],
                )

    return keep


def _cut(size: int, names: list[str]):
    """The kept words of each text, given the places of its repeated windows, if any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                kept, n_words, n_removed = [], [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("_places")):
                    tokens = words(text)
                    removed = 0
                    if places.is_valid:
                        steps = np.zeros(len(tokens) + 1, np.int32)
                        at = np.frombuffer(b"".join(places.as_py()), "<i4")
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + size, -1)
                        covered = np.cumsum(steps)[:-1] > 0
                        removed = int(covered.sum())
                        kept.append(b" ".join([t for t, c in zip(tokens, covered.tolist()) if not c]).decode())
                    else:
                        kept.append(b" ".join(tokens).decode())
                    n_words.append(len(tokens))
                    n_removed.append(removed)
                yield pa.record_batch(
                    [*(part.column(c) for c in names), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                    names=[*names, "kept", "n_words", "n_removed"],
                )

    return cut


def remove_repeats(documents: DataFrame, window: int = WINDOW, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, *carry, kept, n_words, n_removed``, one row per input row.

    ``kept`` holds the words that no removed window covers, joined by one
    space.  Windows are judged on the input.  Texts without a window that the
    sketch marks are finished where they are read; only the others are shuffled.
    """
    spark = documents.sparkSession
    table = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry
    )
    bitmaps, bits = repeated_bitmaps(table.select("text"), window)
    sketch = spark.sparkContext.broadcast(bitmaps)
    narrow = table.select("doc_id", "text")
    counted = narrow.mapInArrow(lean(_candidates(window, sketch, bits, False)), WINDOW_SCHEMA)
    earliest = (
        counted.groupBy("w1", "w2").agg(F.min("order_id").alias("_least"), F.max("order_id").alias("_most"))
        .where("_least < _most").select(F.col("w1").alias("_w1"), F.col("w2").alias("_w2"), "_least")
    )
    placed = narrow.mapInArrow(lean(_candidates(window, sketch, bits, True)), PLACE_SCHEMA)
    later = placed.join(earliest, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2"))).where("order_id > _least")
    # Equal rows hold the same windows at the same places: a set has them once, however many rows there are.
    removed = later.groupBy(F.col("order_id").alias("_id"), F.col("key").alias("_text")).agg(F.collect_set("places").alias("_places"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    split_schema = f"{kinds}, _key long, _order long"
    out_schema = f"{kinds}, kept string, n_words long, n_removed long"
    names = table.columns
    marked = table.mapInArrow(lean(_split(window, sketch, bits, True)), split_schema)
    joined = marked.join(removed, (F.col("_order") == F.col("_id")) & (F.col("_key") == F.col("_text")), "left")
    changed = joined.select(*names, "_places").mapInArrow(lean(_cut(window, names)), out_schema)
    return changed.unionByName(table.mapInArrow(lean(_split(window, sketch, bits, False)), out_schema))
