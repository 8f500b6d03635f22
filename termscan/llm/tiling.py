"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits (lower-cased) and of characters
beyond ASCII.  Each task looks up the word n-grams of its documents among
those of the benchmark items (shared-token seeds, joined by hash); for every
item that shares seeds with a document the pair is tiled: the longest common
run of unmarked words is marked, then the next, down to the seed length, with
runs found by hashes and confirmed word by word.  Tiles do not overlap, so an
item whose sentences were moved about is still covered.  A pair is a leak if
the tiles cover the given share of the item's words.

The benchmark is broadcast in blocks of bounded bytes; a larger one takes more
passes over the documents, and the results are put together.

Defined cases: null and empty texts match nothing; an item shorter than a seed
is matched whole, as one seed of its own length; null ids are carried through;
repeated rows and equal ids are judged each for itself; other columns are
ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.storage import stored
from termscan.llm.texts import WINDOW_BASES, WORD_BASES, lean, span_hashes, text_chunks, window_hashes

SEED = 5
COVERED_PERCENT = 50
BLOCK_BYTES = 32 << 20

MATCH_SCHEMA = "item_id long, item_words int, matched int, tiles int, longest int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tile(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length) of two sequences of word hashes.

    Each round finds the longest common run of unmarked words: hashes of runs
    of a length are compared, doubling and then halving the step, so a round
    costs a few passes.  Of equally long runs the earliest in the item, then in
    the document, is marked first, and all that do not overlap in one round.
    """
    free_d, free_i = np.ones(len(document), bool), np.ones(len(item), bool)
    tiles = []
    longest = min(len(document), len(item))

    def common(length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of free runs of the length in the document that the item has too."""
        places = []
        for values, free in ((document, free_d), (item, free_i)):
            blocked = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(blocked[length:] == blocked[:-length])
            places.append((at, window_hashes(values, length, WINDOW_BASES[0])[at]))
        (at_d, hash_d), (at_i, hash_i) = places
        return at_d[np.isin(hash_d, hash_i)], at_i[np.isin(hash_i, hash_d)]

    while longest >= least:
        low, high = least - 1, longest  # the longest common run lies between
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        in_document, in_item = common(low)
        for i in in_item.tolist():
            if not free_i[i : i + low].all():
                continue
            for d in in_document.tolist():
                if free_d[d : d + low].all() and (document[d : d + low] == item[i : i + low]).all():
                    free_d[d : d + low] = False
                    free_i[i : i + low] = False
                    tiles.append((d, i, low))
                    break
        longest = low
        if not len(in_document):
            break
    return tiles


class Seeds:
    """The items of a block: word hashes, and their n-grams sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int) -> None:
        self.least = least
        self.ids = [item_id for item_id, _ in items]
        texts = pa.array([text for _, text in items], pa.string())
        self.words: list[np.ndarray] = []
        for chunk in text_chunks(texts, _GAP):
            hashes = span_hashes(_LOWER[chunk.data], chunk.starts, chunk.ends, WORD_BASES[0])
            self.words += np.split(hashes, chunk.word_bounds[1:-1])
        short = {len(w) for w in self.words if 0 < len(w) < least}
        self.tables = {}
        for n in sorted({least, *short}):
            chosen = [i for i, w in enumerate(self.words) if (len(w) >= least if n == least else len(w) == n)]
            grams = [window_hashes(self.words[i], n, WINDOW_BASES[1]) for i in chosen]
            owner = np.repeat(np.array(chosen, np.int64), [len(g) for g in grams])
            grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            marks = np.zeros(1 << 20, bool)
            marks[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables[n] = (grams, owner, marks)

    def candidates(self, hashes: np.ndarray, word_bounds: np.ndarray) -> dict[int, set[int]]:
        """Items that share a seed with each text of a chunk."""
        found: dict[int, set[int]] = {}
        for n, (grams, owner, marks) in self.tables.items():
            windows = window_hashes(hashes, n, WINDOW_BASES[1])
            hit = np.flatnonzero(marks[(windows & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low = np.searchsorted(grams, windows[hit], side="left")
            high = np.searchsorted(grams, windows[hit], side="right")
            text = np.searchsorted(word_bounds, hit, side="right") - 1
            inside = (high > low) & (hit + n <= word_bounds[text + 1])
            for t, a, b in zip(text[inside].tolist(), low[inside].tolist(), high[inside].tolist()):
                found.setdefault(t, set()).update(owner[a:b].tolist())
        return found

    def matches(self, document: np.ndarray, item: int) -> tuple[int, int, int]:
        """Covered words, tiles and the longest tile."""
        words = self.words[item]
        tiles = tile(document, words, min(self.least, len(words)))
        lengths = [n for _, _, n in tiles]
        return sum(lengths), len(tiles), max(lengths, default=0)


def _matcher(shared, names: list[str], percent: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        at = names.index("_searched")
        kinds = [pa.int64(), *[pa.int32()] * 4]
        result = ["item_id", "item_words", "matched", "tiles", "longest"]
        for batch in batches:
            for chunk in text_chunks(batch.column(at), _GAP):
                hashes = span_hashes(_LOWER[chunk.data], chunk.starts, chunk.ends, WORD_BASES[0])
                which, rows = [], []
                for text, items in sorted(seeds.candidates(hashes, chunk.word_bounds).items()):
                    document = hashes[chunk.word_bounds[text] : chunk.word_bounds[text + 1]]
                    for item in sorted(items):
                        covered, tiles, longest = seeds.matches(document, item)
                        if 100 * covered >= percent * len(seeds.words[item]):
                            which.append(chunk.first + text)
                            rows.append((seeds.ids[item], len(seeds.words[item]), covered, tiles, longest))
                if rows:
                    taken = batch.take(pa.array(which))
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    given = [n for n in names if n != "_searched"]
                    yield pa.record_batch([*(taken.column(n) for n in given), *columns], names=[*given, *result])

    return match


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of bounded text bytes, one block at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=repr)


def leaks(
    documents: DataFrame, benchmark: DataFrame, carry: Sequence[str] = ("doc_id",), least: int = SEED,
    percent: int = COVERED_PERCENT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row for each document and item it holds: ``*carry, item_id, item_words, matched, tiles, longest``."""
    spark = documents.sparkSession
    table = documents.select(*carry, F.col("text").cast("string").alias("_searched"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*carry).schema)
    schema = f"{kinds}, {MATCH_SCHEMA}"
    parts = []
    for items in benchmark_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Seeds(items, least))
        parts.append(table.mapInArrow(lean(_matcher(shared, table.columns, percent)), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _dropper(shared, names: list[str], percent: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        at = names.index("text")
        for batch in batches:
            for chunk in text_chunks(batch.column(at), _GAP):
                hashes = span_hashes(_LOWER[chunk.data], chunk.starts, chunk.ends, WORD_BASES[0])
                keep = np.ones(len(chunk), bool)
                for text, items in seeds.candidates(hashes, chunk.word_bounds).items():
                    document = hashes[chunk.word_bounds[text] : chunk.word_bounds[text + 1]]
                    for item in items:
                        if keep[text] and 100 * seeds.matches(document, item)[0] >= percent * len(seeds.words[item]):
                            keep[text] = False
                yield batch.take(pa.array(chunk.first + np.flatnonzero(keep)))

    return drop


def without_leaks(
    documents: DataFrame, benchmark: DataFrame, least: int = SEED, percent: int = COVERED_PERCENT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled.

    A block is a pass; between passes the kept rows are stored, so that a task
    holds one block at a time.
    """
    spark = documents.sparkSession
    kept, shared = documents, None
    for items in benchmark_blocks(benchmark, block_bytes):
        if shared is not None:
            kept = stored(kept, "clean")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(Seeds(items, least))
        kept = kept.mapInArrow(lean(_dropper(shared, documents.columns, percent)), documents.schema)
    return kept
