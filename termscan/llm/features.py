"""Statistics of whole documents as numeric columns.

``document_statistics`` adds a table row per document; the statistics of a
chunk of texts are computed at once with numpy.

Defined cases: a null or empty text has zero of everything; texts of any
length are taken whole; ties do not arise; other columns are ignored unless
carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.texts import WINDOW_BASES, Chunk, chunks, lean, span_hashes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "pipe_share", "line_words", "distinct_share", "stop_share",
]
REPEAT_WORDS = 5

# The symbols that count as such.
SYMBOLS = b"#*$%&|<>"


def _flags(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


_SYMBOL = _flags(SYMBOLS)
_PIPE = _flags(b"|")
_MARK = _flags(b"!?")
_UPPER = _flags(range(0x41, 0x5B))
_DIGIT = _flags(range(0x30, 0x3A))
_LETTER = _flags([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_POINT = ~_flags(range(0x80, 0xC0))  # first byte of a code point


class _Sums:
    """Sums of a byte table over spans of a chunk."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data

    def __call__(self, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(flags[self.data], out=total[1:])
        return (total[ends] - total[starts]).astype(np.int64)


def _per_text(chunk: Chunk, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[chunk.word_bounds[1:]] - total[chunk.word_bounds[:-1]]


def _equal_before(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (group, key) pairs in order: whether an equal one came earlier, and whether any other is equal."""
    order = np.lexsort((keys, groups))
    g, k = groups[order], keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    later = same.copy()
    later[:-1] |= same[1:]
    before, shared = np.empty_like(same), np.empty_like(same)
    before[order], shared[order] = same, later
    return before, shared


def chunk_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of a chunk's texts, with the sums the ratios need."""
    n, data = len(chunk), chunk.data
    sums = _Sums(data)
    starts, ends = chunk.bounds[:-1], chunk.bounds[1:]
    out = {"n_words": chunk.n_words.astype(np.int64)}
    out["word_chars"] = _per_text(chunk, sums(_POINT, chunk.starts, chunk.ends))
    out["n_symbols"] = sums(_SYMBOL, starts, ends)
    for name, flags in (("upper", _UPPER), ("digit", _DIGIT), ("letter", _LETTER), ("mark", _MARK), ("pipe", _PIPE)):
        out[name] = sums(flags, starts, ends)

    hashes = chunk.word_hashes()
    text_of_word = np.repeat(np.arange(n), chunk.n_words)
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([starts, breaks + 1]))  # an end of text right after a break adds an empty line
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    text_of_line = np.searchsorted(starts, line_start, side="right") - 1
    closed = (line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == 0x0A) if len(data) else np.zeros(len(line_start), bool)
    line_end = line_end - closed
    first_word = np.searchsorted(chunk.starts, line_start)
    with_word = np.searchsorted(chunk.starts, line_end) > first_word
    line_keys = span_hashes(data, line_start[with_word], line_end[with_word], WINDOW_BASES[0])
    before, _ = _equal_before(text_of_line[with_word], line_keys)
    out["n_lines"] = np.bincount(text_of_line[with_word], minlength=n)
    out["n_dup_lines"] = np.bincount(text_of_line[with_word][before], minlength=n)

    text, first = chunk.windows(REPEAT_WORDS)
    keys = span_hashes(hashes, first, first + REPEAT_WORDS, WINDOW_BASES[0])
    _, shared = _equal_before(text, keys)
    steps = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(steps, first[shared], 1)
    np.add.at(steps, first[shared] + REPEAT_WORDS, -1)
    out["n_repeat_words"] = _per_text(chunk, (np.cumsum(steps)[:-1] > 0).astype(np.int64))

    repeated_word, _ = _equal_before(text_of_word, hashes)
    out["distinct"] = _per_text(chunk, (~repeated_word).astype(np.int64))
    short = chunk.ends - chunk.starts <= 3
    out["short"] = _per_text(chunk, short.astype(np.int64))
    return out


def ratios(counts: dict[str, np.ndarray], n_bytes: np.ndarray) -> np.ndarray:
    """The model's features, a row per text in the order of ``RATIOS``."""
    words = np.maximum(counts["n_words"], 1)
    size = np.maximum(n_bytes, 1)
    return np.column_stack([
        np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / size,
        counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1), counts["n_repeat_words"] / words,
        counts["upper"] / np.maximum(counts["letter"], 1), counts["digit"] / size, counts["mark"] / size,
        counts["pipe"] / size, counts["n_words"] / np.maximum(counts["n_lines"], 1),
        counts["distinct"] / words, counts["short"] / words,
    ])


def _measure(given: list[str], forest):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(len(given))):
                counts = chunk_counts(chunk)
                features = ratios(counts, np.diff(chunk.bounds))
                rows = batch.slice(chunk.first, len(chunk))
                columns = [*rows.columns[: len(given)], *(pa.array(counts[c], pa.int64()) for c in COUNTS)]
                if forest is None:
                    bounds = np.arange(0, features.size + 1, len(RATIOS), dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(features.ravel())))
                else:
                    columns.append(pa.array(forest.value.score(features)))
                yield pa.record_batch(columns, names=[*given, *COUNTS, "features" if forest is None else "log_odds"])

    return measure


def document_statistics(documents: DataFrame, carry: Sequence[str] = ("doc_id",), forest: Broadcast | None = None) -> DataFrame:
    """``*carry``, the counts, and the array ``features``, or with a forest its ``log_odds``.

    Carried columns must not be named like a result.
    """
    clash = {c.lower() for c in carry} & {*COUNTS, "features", "log_odds"}
    if clash:
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    given = documents.select(*carry)
    table = documents.select(*carry, F.col("text").cast("string")).toDF(*[f"_{i}" for i in range(len(carry) + 1)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    last = "features array<double>" if forest is None else "log_odds double"
    return table.mapInArrow(lean(_measure(list(carry), forest)), f"{kinds}, {counts}, {last}")
