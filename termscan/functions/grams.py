"""Which terms of a vocabulary a text holds, and how often, by the short byte sequences of the text.

A gram of ``n`` bytes is the number its bytes form, the first byte highest; of
at most ``GRAM_BYTES`` bytes, so it fits a long.  Strings are UTF-8, where a
string holds another exactly if its bytes do.

The functions that run in tasks are nested so that they are shipped by value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM_BYTES = 7
# Bytes of text that a task looks at in one step, whatever the texts' lengths.
WINDOW = 1 << 18
# Cells of the table of (text, needle) counted in a step; beyond it the pairs are sorted.
MOST_CELLS = 1 << 22


def gram_size(needle: Column) -> Column:
    return F.least(F.octet_length(needle), F.lit(GRAM_BYTES))


def first_gram(needle: Column) -> Column:
    """The number of the first gram of needles that are not empty."""
    first = F.substring(F.encode(needle, "UTF-8"), 1, GRAM_BYTES)
    return F.conv(F.hex(first), 16, 10).cast("long")


def all_grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct numbers of all grams of these lengths of a text."""
    return F.arrow_udf(_every_gram(sorted(map(int, sizes))), "array<bigint>")(text)


def needle_counts(text: Column, needles: Sequence[str]) -> Column:
    """``needle, n`` of every needle that a text holds: its place in the list, and how often, left to right without overlaps.

    The needles differ and none is empty.  Each length of first grams takes one
    pass over a text, so the work grows with the text and with what is found in it.
    """
    return F.arrow_udf(_counter([n.encode() for n in needles]), "array<struct<needle:int,n:int>>")(text)


def _every_gram(sizes: list[int]) -> Callable[[pa.Array], pa.Array]:
    def grams(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist():
            data = np.frombuffer(text or b"", np.uint8).astype(np.int64)
            number, parts = np.zeros(len(data), np.int64), [np.zeros(0, np.int64)]
            for size in range(1, min(max(sizes, default=0), len(data)) + 1):
                number = (number[:len(data) - size + 1] << 8) | data[size - 1:]
                if size in sizes:
                    parts.append(np.unique(number))
            found.append(np.unique(np.concatenate(parts)))
        return pa.array(found, pa.list_(pa.int64()))

    return grams


def _counter(needles: list[bytes]) -> Callable[[pa.Array], pa.Array]:
    width = len(needles)
    length = np.array([len(n) for n in needles], np.int64)
    letters = np.frombuffer(b"".join(needles), np.uint8)
    begin = np.cumsum(length) - length
    overlaps = np.array([any(n.startswith(n[i:]) for i in range(1, len(n))) for n in needles], np.bool_)
    mixer = np.uint64(0x9E3779B97F4A7C15)

    # For each length of first grams: their numbers, the needles of each, and a
    # table of where the numbers hash to, which few other numbers do.
    by_size: dict[int, dict[int, list[int]]] = {}
    for i, needle in enumerate(needles):
        first = needle[:GRAM_BYTES]
        by_size.setdefault(len(first), {}).setdefault(int.from_bytes(first, "big"), []).append(i)
    layers = {}
    for size, members in by_size.items():
        numbers = np.array(sorted(members), np.uint64)
        lists = [members[int(n)] for n in numbers]
        counts = np.array([len(m) for m in lists], np.int64)
        shift = np.uint64(64 - max(12, (16 * len(numbers)).bit_length()))
        marked = np.zeros(1 << (64 - int(shift)), np.bool_)
        marked[((numbers * mixer) >> shift).astype(np.int64)] = True
        layers[size] = shift, marked, numbers, counts, np.cumsum(counts) - counts, np.array([i for m in lists for i in m], np.int64)

    def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[heads], np.add.reduceat(n, heads) if len(key) else n

    def found_in(data: np.ndarray, ends: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, needle and place of all matches that begin in a window."""
        first, last = (int(np.searchsorted(ends, at, "right")) for at in (start, stop - 1))
        borders, n = ends[first:last] - start, stop - start
        ahead = np.zeros(n + GRAM_BYTES, np.uint64)
        there = data[start:stop + GRAM_BYTES]
        ahead[:len(there)] = there
        number, mixed = np.zeros(n, np.uint64), np.empty(n, np.uint64)
        matches = []
        for size in range(1, max(layers) + 1):
            np.left_shift(number, np.uint64(8), out=number)
            np.bitwise_or(number, ahead[size - 1:size - 1 + n], out=number)
            if size not in layers:
                continue
            shift, marked, numbers, counts, offsets, members = layers[size]
            np.multiply(number, mixer, out=mixed)
            np.right_shift(mixed, shift, out=mixed)
            at = np.flatnonzero(marked[mixed.view(np.int64)])
            place = np.minimum(np.searchsorted(numbers, number[at]), len(numbers) - 1)
            same = numbers[place] == number[at]
            at, place = at[same], place[same]
            # Places rise, so the ends of texts among them tell the text of each.
            cuts = np.searchsorted(at, borders)
            text = first + np.repeat(np.arange(len(borders) + 1), np.diff(cuts, prepend=0, append=len(at)))
            at = at + start
            if size == GRAM_BYTES:
                # Several needles may begin so; the rest of each is compared.
                times = counts[place]
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                needle = members[np.repeat(offsets[place], times) + within]
                at, text = np.repeat(at, times), np.repeat(text, times)
            else:
                needle = members[offsets[place]]
            whole = at + length[needle] <= ends[text]
            text, needle, at = text[whole], needle[whole], at[whole]
            if size == GRAM_BYTES:
                good = np.ones(len(at), np.bool_)
                open_, step = np.flatnonzero(length[needle] > size), size
                while len(open_):
                    equal = data[at[open_] + step] == letters[begin[needle[open_]] + step]
                    good[open_[~equal]] = False
                    step += 1
                    open_ = open_[equal]
                    open_ = open_[length[needle[open_]] > step]
                text, needle, at = text[good], needle[good], at[good]
            matches.append((text, needle, at))
        return tuple(np.concatenate(c) for c in zip(*matches))

    def without_overlaps(key: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which matches count, for needles that may overlap themselves; in order of key and place."""
        counted = np.ones(len(key), np.bool_)
        close = np.flatnonzero((key[1:] == key[:-1]) & (at[1:] - at[:-1] < size[1:])) + 1
        last_key, free = -1, 0
        for i in close.tolist():
            if key[i] != last_key or counted[i - 1]:
                last_key, free = key[i], at[i - 1] + size[i] if counted[i - 1] else free
            counted[i] = at[i] >= free
        return counted

    def count(texts: pa.Array) -> pa.Array:
        n = len(texts)
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.binary())
        texts = texts.cast(pa.large_binary())
        _, offsets, content = texts.buffers()
        keys, times, pending, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
        if n and content is not None and layers:
            edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
            data, ends = np.frombuffer(content, np.uint8)[edges[0]:edges[-1]], edges[1:] - edges[0]
            total = len(data)
        for start in range(0, total, WINDOW):
            text, needle, at = found_in(data, ends, start, min(start + WINDOW, total))
            key, own = text * width + needle, overlaps[needle]
            pending.append((key[own], at[own]))
            key = key[~own]
            low = int(text.min()) * width if len(text) else 0
            if len(key) and int(key.max()) - low < MOST_CELLS:
                cells = np.bincount(key - low)
                key = np.flatnonzero(cells)
                times.append(cells[key])
                keys.append(key + low)
            else:
                key, counted = summed(key, np.ones(len(key), np.int64))
                keys.append(key)
                times.append(counted)
        if pending:
            key, at = (np.concatenate(c) for c in zip(*pending))
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
            keys.append(key[without_overlaps(key, at, length[key % width])])
            times.append(np.ones(len(keys[-1]), np.int64))
        key, n_found = summed(np.concatenate(keys), np.concatenate(times))
        rows = pa.StructArray.from_arrays([pa.array(key % max(width, 1), pa.int32()), pa.array(n_found, pa.int32())], ["needle", "n"])
        begins = np.searchsorted(key, np.arange(n + 1) * width)
        return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rows)

    return count
