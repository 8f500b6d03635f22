"""A hidden Markov language model of words.

Words (lower-cased in A to Z) are counted over all training documents.  The
most frequent ones have an emission probability of their own in every state;
every other word is emitted through the class of its last letters and then by
its own count within that class, so every word of the corpus, however rare,
and the event of an unknown word have a probability.  The states and their
emissions are trained by Baum-Welch: every task runs scaled forward and
backward recursions over its documents and sums expected counts, which are
added up in a tree of tasks.  Scoring runs the scaled forward recursion over
the whole text.

Frequent counts are broadcast, at most ``SHARED_WORDS`` of them; counts of
other words are joined by word.  Words are compared by 64-bit hashes.  For
training, texts are cut into sequences of ``TRAIN_STEPS`` tokens; scores are
of whole texts.

Defined cases: a null or empty text is its end alone; a null id is a training
id; without training text every probability falls back to that of an unknown
word; equal ids and repeated rows are documents like others; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm.storage import stored
from termscan.llm.texts import WORD_BASES, Chunk, chunks, mix, span_hashes

STATES = 8
ROUNDS = 6
OWN_WORDS = 16_384
CLASSES = 1_024
SHARED_WORDS = 1 << 18
TRAIN_STEPS = 256
TRAIN_WIDTH = 2_048
SMOOTHING = 20.0
END = 0  # the symbol of the end of a text; then come own words, then classes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

VOCABULARY_SCHEMA = "key long, class int, count long"
ENCODED_SCHEMA = "row long, doc_id long, held_out boolean, n_words long, n_known long, log_counts double, log_class double, symbols binary, rare binary"


def words_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Key and spelling class (last three bytes) of every word of a chunk."""
    lower = _LOWER[chunk.data]
    key = span_hashes(lower, chunk.starts, chunk.ends, WORD_BASES[0]).view(np.int64)
    ending = np.zeros(len(key), np.uint64)
    for back in range(1, 4):
        at = chunk.ends - back
        inside = at >= chunk.starts
        ending = ending * np.uint64(257) + np.where(inside, lower[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return key, (mix(ending) % np.uint64(CLASSES)).astype(np.int32)


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "class", "count"]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.concatenate([h[0] for h in held])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(np.concatenate([h[2] for h in held])[order], first) if len(key) else key
        return key[first], np.concatenate([h[1] for h in held])[order][first], total

    for batch in batches:
        for chunk in chunks(batch.column(0)):
            key, kind = words_of(chunk)
            found, first, counts = np.unique(key, return_index=True, return_counts=True)
            held.append((found, kind[first], counts))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [merged()]
                if len(held[0][0]) > 1 << 19:
                    yield pa.record_batch([pa.array(c) for c in held[0]], names=names)
                    held = []
    if held:
        yield pa.record_batch([pa.array(c) for c in merged()], names=names)


def vocabulary(texts: DataFrame) -> DataFrame:
    """``key, class, count`` of all words, counted within tasks first; stored."""
    partial = texts.mapInArrow(_word_counter, VOCABULARY_SCHEMA)
    return stored(partial.groupBy("key", "class").agg(F.sum("count").alias("count")), "vocabulary")


@dataclass(frozen=True)
class Lexicon:
    """Counts of frequent words by key, symbols of the most frequent, totals of the classes."""

    keys: np.ndarray  # sorted
    counts: np.ndarray
    symbols: np.ndarray  # -1: emitted through the class
    class_totals: np.ndarray
    own: int
    n_end: int
    n_tokens: int
    n_distinct: int

    @property
    def size(self) -> int:
        return 1 + self.own + CLASSES


def lexicon(words: DataFrame, documents: int) -> Lexicon:
    """The bounded part of the vocabulary that every task gets.

    The cut lies at a step of the count's logarithm below which the words
    would be too many, so the rows that reach the driver are bounded.
    """
    step = F.floor(F.log2(F.col("count").cast("double")) * 16).cast("int")
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("count").alias("tokens")).collect()
    shared, least = 0, 1 << 30
    for row in sorted(steps, key=lambda r: -r["step"]):
        shared += row["words"]
        if shared > SHARED_WORDS:
            break
        least = row["step"]
    frequent = words.where(step >= least).select("key", "class", "count").toPandas()
    frequent = frequent.sort_values(["count", "key"], ascending=[False, True], ignore_index=True)
    own = min(OWN_WORDS, len(frequent))
    symbols = np.where(np.arange(len(frequent)) < own, np.arange(len(frequent)) + 1, -1).astype(np.int32)
    kinds = frequent["class"].to_numpy(np.int64)
    counts = frequent["count"].to_numpy(np.int64)
    totals = np.ones(CLASSES)  # the unknown word
    for row in words.groupBy("class").agg(F.sum(F.col("count") + 1).alias("total")).collect():
        totals[row["class"]] += row["total"]
    totals -= np.bincount(kinds[:own], counts[:own] + 1, CLASSES)
    order = np.argsort(frequent["key"].to_numpy(np.int64), kind="stable")
    n_words = sum(r["tokens"] for r in steps)
    return Lexicon(
        frequent["key"].to_numpy(np.int64)[order], counts[order], symbols[order], totals, own, documents,
        n_words + documents, sum(r["words"] for r in steps) + (documents > 0),
    )


def _coder(shared):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        names = [field.split()[0] for field in ENCODED_SCHEMA.split(", ")]
        for batch in batches:
            for chunk in chunks(batch.column(3)):
                key, kind = words_of(chunk)
                at = np.minimum(np.searchsorted(lex.keys, key), max(len(lex.keys) - 1, 0))
                found = lex.keys[at] == key if len(lex.keys) else np.zeros(len(key), bool)
                count = np.where(found, lex.counts[at], 0) if len(lex.keys) else np.zeros(len(key), np.int64)
                symbol = np.where(found, lex.symbols[at], -1) if len(lex.keys) else np.full(len(key), -1)
                through = symbol < 0
                symbol = np.where(through, 1 + lex.own + kind, symbol).astype("<u2")
                log_count = np.log10(count + 1.0)
                in_class = np.where(through, np.where(found, log_count, 0.0) - np.log10(lex.class_totals[kind]), 0.0)
                bounds = chunk.word_bounds

                def sums(values: np.ndarray) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(values)])
                    return total[bounds[1:]] - total[bounds[:-1]]

                rare = [key[a:b][~found[a:b]].astype("<i8").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                coded = [symbol[a:b].tobytes() + b"\0\0" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                rows = batch.slice(chunk.first, len(chunk))
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), rows.column(2), pa.array(chunk.n_words.astype(np.int64)),
                     pa.array(sums(found).astype(np.int64)), pa.array(sums(np.where(found, log_count, 0.0))), pa.array(sums(in_class)),
                     pa.array(coded, pa.binary()), pa.array(rare, pa.binary())],
                    names=names,
                )

    return code


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def _ordered(column: pa.Array, steps: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of a batch side by side, with begin and length of its sequences, longest first, and their rows."""
    sizes = np.array([len(s) // 2 for s in column.to_pylist()], np.int64)
    symbols = np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.arange(len(sizes))
    if steps is not None:
        parts = -(-sizes // steps)
        row = np.repeat(row, parts)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, sizes = begin[row] + inner * steps, np.minimum(steps, sizes[row] - inner * steps)
    order = np.argsort(-sizes, kind="stable")
    return symbols, begin[order], sizes[order], row[order]


def expected_counts(model: Model, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of sequences, longest first: start, moves, emissions in one vector."""
    states, n_symbols = len(model.start), len(model.emit)
    start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, n_symbols))
    emit = model.emit.astype(np.float32)
    move = model.move.astype(np.float32)
    for first in range(0, len(sizes), TRAIN_WIDTH):
        b, n = begin[first : first + TRAIN_WIDTH], sizes[first : first + TRAIN_WIDTH]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(steps), side="left")  # sequences longer than t
        seen, forward, scale = [], [], []
        for t in range(steps):
            a = active[t]
            s = symbols[b[:a] + t]
            e = emit[s]
            f = e * model.start.astype(np.float32) if t == 0 else (forward[-1][:a] @ move) * e
            c = f.sum(1, keepdims=True)
            seen.append(s)
            forward.append(f / c)
            scale.append(c)
        posterior = [None] * steps
        back = np.ones((active[-1], states), np.float32)
        for t in range(steps - 1, -1, -1):
            if active[t] > len(back):
                back = np.concatenate([back, np.ones((active[t] - len(back), states), np.float32)])
            posterior[t] = forward[t] * back
            if t:
                weighted = emit[seen[t]] * back / scale[t]
                moves += (forward[t - 1][: active[t]].T @ weighted) * move
                back = weighted @ move.T
        start += posterior[0].sum(0)
        flat, where = np.concatenate(posterior), np.concatenate(seen)
        for k in range(states):
            emits[k] += np.bincount(where, flat[:, k], n_symbols)
    return np.concatenate([start, moves.ravel(), emits.ravel()])


def sequence_log10(model: Model, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of whole sequences, longest first, by the scaled forward recursion."""
    out = np.zeros(len(sizes))
    if not len(sizes):
        return out
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    state = np.empty((0, 0))
    for t in range(int(sizes[0])):
        a = active[t]
        e = model.emit[symbols[begin[:a] + t]]
        state = e * model.start if t == 0 else (state[:a] @ model.move) * e
        c = state.sum(1)
        out[:a] += np.log10(c)
        state /= c[:, None]
    return out


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total = None
        for batch in batches:
            for first in range(0, batch.num_rows, TRAIN_WIDTH):
                symbols, begin, sizes, _ = _ordered(batch.column(0).slice(first, TRAIN_WIDTH), TRAIN_STEPS)
                counts = expected_counts(model, symbols, begin, sizes)
                total = counts if total is None else total + counts
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return count


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for counts in batch.column(0):
            part = np.frombuffer(counts.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def tree_sum(partial: DataFrame, tasks: int, width: int = 16) -> np.ndarray | None:
    """Sum of vectors, one per task: ``width`` of them meet in a task, until few are left."""
    while tasks > width:
        tasks = -(-tasks // width)
        partial = partial.repartition(tasks).mapInArrow(_adder, "counts binary")
    vectors = [np.frombuffer(row["counts"]) for row in partial.collect()]
    return sum(vectors) if vectors else None


def first_model(lex: Lexicon, encoded: DataFrame, frequency: np.ndarray, states: int) -> Model:
    """States that lean towards one document each: those with the smallest hash of their symbols."""
    chosen = encoded.where("n_words >= 50").orderBy(F.xxhash64("symbols"), "row").limit(states).select("symbols").collect()
    emit = np.tile(frequency, (states, 1))
    for k, row in enumerate(chosen):
        found = np.bincount(np.frombuffer(row["symbols"], "<u2"), minlength=lex.size)
        emit[k] = 0.5 * frequency + 0.5 * found / found.sum()
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    if states == 1:
        move[:] = 1
    return Model(np.full(states, 1 / states), move, emit.T.copy())


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training documents of the encoded table."""
    spark = encoded.sparkSession
    learning = encoded.where("NOT held_out")
    frequency = np.full(lex.size, 0.5)
    frequency[END] += lex.n_end
    own = lex.symbols > 0
    frequency[lex.symbols[own]] += lex.counts[own]
    frequency[1 + lex.own :] += lex.class_totals
    frequency /= frequency.sum()
    model = first_model(lex, learning, frequency, states)
    symbols = learning.select("symbols")
    tasks = symbols.rdd.getNumPartitions()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        counts = tree_sum(symbols.mapInArrow(_counter(shared), "counts binary"), tasks)
        shared.unpersist()
        if counts is None:
            break
        start, moves, emits = np.split(counts, [states, states + states * states])
        start = start + 1
        moves = moves.reshape(states, states) + 1
        emits = emits.reshape(states, lex.size) + SMOOTHING * frequency
        model = Model(start / start.sum(), moves / moves.sum(1, keepdims=True), (emits / emits.sum(1, keepdims=True)).T.copy())
    return model


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = ["row", "doc_id", "held_out", "n_words", "n_known", "log_counts", "log_class"]
        for batch in batches:
            symbols, begin, sizes, row = _ordered(batch.column("symbols"), None)
            found = np.empty(len(row))
            found[row] = sequence_log10(model, symbols, begin, sizes)
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(found)], names=[*names, "log_symbols"])

    return score


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rare = batch.column("rare").to_pylist()
        row = np.repeat(batch.column("row").to_numpy(), [len(r) // 8 for r in rare])
        yield pa.record_batch([pa.array(row), pa.array(np.frombuffer(b"".join(rare), "<i8"))], names=["row", "key"])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_documents(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = documents.sparkSession
    doc_id = F.col("doc_id").cast("long")
    table = documents.select(
        F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    words = vocabulary(table.where("NOT held_out").select("text"))
    lex = lexicon(words, table.where("NOT held_out").count())
    encoded = stored(table.mapInArrow(_coder(spark.sparkContext.broadcast(lex)), ENCODED_SCHEMA), "symbols")
    model = train(encoded, lex, states, rounds)

    rare = encoded.select("row", "rare").mapInArrow(_unpack, "row long, key long")
    counts = words.select(F.col("key").alias("_key"), "count")
    joined = rare.join(counts, F.col("key") == F.col("_key"), "left")
    sums = joined.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.log10(F.coalesce("count", F.lit(0)) + F.lit(1.0))).alias("rare_log"), F.count("count").alias("rare_known")
    )
    scored = encoded.drop("rare").mapInArrow(
        _scorer(spark.sparkContext.broadcast(model)),
        "row long, doc_id long, held_out boolean, n_words long, n_known long, log_counts double, log_class double, log_symbols double",
    )
    both = scored.join(sums, F.col("row") == F.col("_row"), "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    per_token = float(np.log10(lex.n_tokens + lex.n_distinct + 1))
    n_tokens = F.col("n_words") + 1
    return both.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(lex.n_end > 0))).cast("long").alias("n_known"),
        F.lit(int(lex.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rare_log + F.lit(float(np.log10(lex.n_end + 1))) - n_tokens * F.lit(per_token)).alias("base_score"),
        (F.col("log_symbols") + F.col("log_class") + rare_log).alias("score"),
    )
