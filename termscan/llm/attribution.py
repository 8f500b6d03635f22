"""Token counts of sections, from one encoding of each whole document.

A byte-level token stands for a known number of bytes, so the spans of a
document's tokens are running sums over its ids.  Sections are character
spans; each is joined to the tokens of its document by binary search in the
sorted spans.  A token that crosses a section's bounds goes by a rule:

``first``  to the section that holds its first byte (the default)
``last``   to the section that holds its last byte
``share``  to each section by the share of its bytes there

Sections that cover a document without overlap get all its tokens under any
rule.  Sections may also overlap or leave gaps; each is counted for itself.

Defined cases: without given sections, lines are sections (a line holds its
line end; no section follows the last one); a null or empty text, or an empty
list of sections, gives one section of no characters; null and reversed spans
count as empty, spans beyond the text are cut; ids and repeated rows are taken
as they come; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.llm.tokens import encoder

RULES = ("first", "last", "share")
SPANS = "array<struct<start:int,end:int>>"

_lengths: dict[str, np.ndarray] = {}


def token_lengths(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level tokenizer stands for."""
    if path not in _lengths:
        tokenizer = encoder(path, False).tokenizer
        out = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, number in tokenizer.get_vocab().items():
            out[number] = len(token)
        for number, added in tokenizer.get_added_tokens_decoder().items():
            out[number] = len(added.content.encode())
        _lengths[path] = out
    return _lengths[path]


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text, at least one."""
    ends = np.flatnonzero(data == 0x0A) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]), ends


def count_tokens(begin: np.ndarray, length: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each byte span, for tokens that follow one another from ``begin``."""
    if rule == "share":
        bounds = np.append(begin, begin[-1] + length[-1] if len(begin) else 0)

        def upto(x: np.ndarray) -> np.ndarray:
            return np.interp(x, bounds, np.arange(len(bounds))) if len(begin) else np.zeros(len(x))

        return upto(end) - upto(start)
    marks = begin if rule == "first" else begin + length - 1
    return (np.searchsorted(marks, end) - np.searchsorted(marks, start)).astype(float)


def _counter(path: str, rule: str, given: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = encoder(path, False), token_lengths(path)
        kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
        result = ["section", "start", "n_chars", "n_tokens", "n_crossing", "doc_tokens"]
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column("_text").to_pylist()
                wanted = part.column("_spans").to_pylist() if "_spans" in part.schema.names else [None] * len(texts)
                which: list[np.ndarray] = []
                columns: list[list[np.ndarray]] = [[] for _ in result]
                for row, (text, ids, spans) in enumerate(zip(texts, codes.encode(texts), wanted)):
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    length = lengths[np.frombuffer(ids, "<u4")]
                    begin = np.cumsum(length) - length
                    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte place of each character
                    if "_spans" in part.schema.names:
                        pairs = [(s["start"] or 0, s["end"] or 0) if s else (0, 0) for s in spans or [None]]
                        bounds = np.clip(np.array(pairs, np.int64), 0, len(points) - 1)
                        bounds[:, 1] = np.maximum(bounds[:, 0], bounds[:, 1])
                        start_char, end_char = bounds.T
                        start, end = points[start_char], points[end_char]
                    else:
                        start, end = line_spans(data)
                        start_char, end_char = np.searchsorted(points, start), np.searchsorted(points, end)
                    inner = np.searchsorted(begin, end) - 1  # the last token that begins before the end
                    crossing = (inner >= 0) & (end > start)
                    if len(begin):
                        crossing &= (begin + length)[np.maximum(inner, 0)] > end
                    else:
                        crossing[:] = False
                    n = len(start)
                    which.append(np.full(n, row))
                    values = (np.arange(n), start_char, end_char - start_char, count_tokens(begin, length, start, end, rule), crossing, np.full(n, len(length)))
                    for column, value in zip(columns, values):
                        column.append(value)
                taken = part.take(pa.array(np.concatenate(which)))
                made = [pa.array(np.concatenate(c)).cast(k) for c, k in zip(columns, kinds)]
                yield pa.record_batch([*(taken.column(n) for n in given), *made], names=[*given, *result])

    return count


def section_tokens(
    documents: DataFrame, path: str, sections: Column | None = None, rule: str = "first", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``*carry, section, start, n_chars, n_tokens, n_crossing, doc_tokens``, a row per section.

    ``path`` names a byte-level tokenizer; ``sections`` is an array of
    (start, end) in characters.  ``n_crossing`` counts the tokens that go on
    beyond the section's end (0 or 1); ``n_tokens`` is whole but for ``share``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    extra = [] if sections is None else [sections.cast(SPANS).alias("_spans")]
    table = documents.select(*carry, F.col("text").cast("string").alias("_text"), *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*carry).schema)
    schema = f"{kinds}, section long, start long, n_chars long, n_tokens double, n_crossing long, doc_tokens long"
    return table.mapInArrow(_counter(path, rule, list(carry)), schema)
