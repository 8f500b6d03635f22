"""Words of Arrow text batches as numpy arrays, and hashes of words and windows.

A word is a run of characters other than ASCII white space, so texts can be
cut on their UTF-8 bytes.  All functions work on chunks of whole texts of
bounded size (one longer text is a chunk of its own).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd bases of polynomial hashes modulo 2**64: two for words, two for windows.
WORD_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

# What this process remembers for other kinds of work; let go when texts are cut
# into words, so that a worker that goes on to another stage starts small.
memories: list[dict] = []

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below ``n`` at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES)

        def table(factor: int) -> np.ndarray:
            out = np.full(size, factor, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        have = (table(base), table(pow(base, -1, 1 << 64)))
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def release() -> None:
    """Give free memory of this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work of a task; its worker keeps no free memory for the tasks after it."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values; empty if there are fewer."""
    starts = np.arange(max(0, len(words) - n + 1))
    return span_hashes(words, starts, starts + n, base)


class Chunk:
    """Some consecutive texts: their bytes and the bounds of their words."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> None:
        self.first = first  # row of the first text in its batch
        self.data = data
        self.bounds = bounds  # byte bounds of the texts, one more than texts
        edges = np.diff(space[data].astype(np.int8), prepend=1, append=1)
        if len(bounds) > 2:  # texts lie side by side: a word ends with its text
            begin = np.flatnonzero(edges == -1)
            inner = bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            joined = np.unique(inner[~space[data[inner]] & ~space[data[inner - 1]]])
            self.starts = np.sort(np.concatenate([begin, joined]))
            self.ends = np.sort(np.concatenate([np.flatnonzero(edges == 1), joined]))
        else:
            self.starts = np.flatnonzero(edges == -1)
            self.ends = np.flatnonzero(edges == 1)
        self.word_bounds = np.searchsorted(self.starts, bounds)  # first word of each text

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, WORD_BASES[which])

    def joined(self) -> pa.Array:
        """The words of each text, joined by one space."""
        last = np.zeros(len(self.ends), bool)
        last[self.word_bounds[1:][self.n_words > 0] - 1] = True
        gaps = self.ends[~last]  # white space follows a word that is not the last of its text
        data = self.data.copy()
        data[gaps] = 0x20
        kept = ~_SPACE[self.data]
        kept[gaps] = True
        sizes = np.concatenate([[0], np.cumsum(kept)])[self.bounds]
        buffers = [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[kept])]
        return pa.Array.from_buffers(pa.large_string(), len(self), buffers)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and first word of every window of ``n`` words within one text."""
        counts = np.maximum(self.n_words - n + 1, 0)
        text = np.repeat(np.arange(len(self)), counts)
        skipped = self.word_bounds[:-1] - (np.cumsum(counts) - counts)
        return text, np.arange(len(text)) + skipped[text]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A string column as chunks; a null text is an empty one."""
    return text_chunks(column, _SPACE, limit)


def text_chunks(column: pa.Array, space: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The same for words between the bytes that the table ``space`` marks."""
    for memory in memories:
        memory.clear()
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    n = len(array)
    if n == 0:
        return
    _, offsets, values = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and bounds[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield Chunk(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], space)
        first = last


def words(text: str | None) -> list[bytes]:
    """The words of one text, as UTF-8."""
    return (text or "").encode().split()
