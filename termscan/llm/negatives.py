"""Hard negatives: rows of other labels that score just below an anchor's positives.

Vectors become integers; a score is their exact inner product.  Every row is
stored with its norm and its angles to a few reference directions (the sums of
unit vectors by label).  The angle between an anchor and a row lies between
the difference and the sum of their angles to each reference, which gives an
interval of the cosine and, times both norms and widened for rounding, of the
score.  Only rows whose interval can reach what is looked for are scored:

* positives: those whose upper bound reaches the k-th largest lower bound;
* negatives: those whose interval meets a window of the anchor's positives.

Anchors are a stated query set.  They are written in files of a bounded number
of rows; every task reads those files one after the other and compares each
block with its own rows, so neither the driver nor a shuffle carries vectors.
Tasks return a bounded number of rows per anchor, of which the first are taken.

Defined cases: rows with a null label or vector, with a null or non-finite
component, or of another length than the most frequent one take no part; a row
with a null id is never an anchor, can be a positive or negative and comes last
among ties; rows that share the anchor's id are not its others; repeated
anchors count once, repeated candidates each; of a zero vector all scores are
0; an anchor without positives, or a positive without negatives, has no rows;
an empty table gives none; other columns are ignored.  Components beyond 31
bits and scores beyond 62 raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termscan.llm.storage import open_input, shared_path
from termscan.llm.vectors import PARTIAL_SCHEMA, batches_of, binaries, common_length, from_binaries, matrix, partial_rows, summed, whole

SCALE = 256
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
# A negative scores from 30 to 90 hundredths of its positive.
WINDOW = (30, 90)
REFERENCES = 16
# Anchors in a block, and bytes of a task's rows (as doubles) that are compared with a block at once.
BLOCK_ROWS = 2048
CHUNK_BYTES = 48 << 20
# Angles are known within 1e-7 (the arc cosine near 1), so cosines of their sums within 2e-7.
COSINE_MARGIN = 1e-6

LAST_ID = np.iinfo(np.int64).max


def _integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * values)
    if len(scaled) and np.abs(scaled).max(initial=0.0) >= 2.0**31:
        raise OverflowError("a component is too large for 31 bits")
    return scaled


def _directions(width: int):
    """Sums of unit vectors, a matrix row per class of labels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((REFERENCES, width), "<f8")
        for batch in batches:
            x = _integers(matrix(batch.column(1), width))
            norm = np.sqrt((x * x).sum(1))
            np.add.at(total, batch.column(0).to_numpy(), x / np.where(norm > 0, norm, 1)[:, None])
        if total.any():
            yield partial_rows(total)

    return add


def references(rows: DataFrame, width: int) -> np.ndarray:
    """Unit vectors, at most ``REFERENCES``."""
    classes = rows.select(F.pmod("label", F.lit(REFERENCES)).cast("int").alias("class"), "vector")
    sums = summed(classes.mapInArrow(_directions(width), PARTIAL_SCHEMA), REFERENCES, width, "<f8")
    norms = np.sqrt((sums * sums).sum(1))
    return sums[norms > 0] / norms[norms > 0][:, None]


def _measure(width: int, directions: np.ndarray):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(matrix(batch.column(2), width))
            norm = np.sqrt((x * x).sum(1))
            cosines = (x @ directions.T) / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosines, -1, 1))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), binaries(x, "<i4"), pa.array(norm), binaries(angles, "<f8")],
                names=["vec_id", "label", "x", "norm", "angles"],
            )

    return measure


MEASURED = "vec_id long, label long, x binary, norm double, angles binary"


class Rows:
    """Some rows as arrays, ordered by label."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, k: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("vec_id").combine_chunks()
        labels = table.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        self.ids = ids.fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False)[order]
        self.labels = labels[order]
        self.x = from_binaries(table.column("x").combine_chunks(), "<i4", width)[order].astype(float)
        self.norm = table.column("norm").to_numpy()[order]
        angles = from_binaries(table.column("angles").combine_chunks(), "<f8", k)[order].T
        self.cos, self.sin = np.cos(angles), np.sin(angles)  # a row per reference
        self.most = float(self.norm.max(initial=0.0))

    def label_range(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def bounds(self, cos: np.ndarray, sin: np.ndarray, norm: float, which: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which values the scores against an anchor lie."""
        size = self.norm[which]
        low, high = np.full(len(size), -1.0), np.full(len(size), 1.0)
        for c, s, cx, sx in zip(cos, sin, self.cos, self.sin):
            cc, ss = c * cx[which], s * sx[which]
            np.minimum(high, cc + ss, out=high)  # cosine of the difference of the angles
            # Cosine of their sum; beyond a half turn (both cosines add up below 0) nothing is known.
            np.maximum(low, np.where(c + cx[which] < 0, -1.0, cc - ss), out=low)
        scale = size * norm
        return np.floor((low - COSINE_MARGIN) * scale) - 1, np.ceil((high + COSINE_MARGIN) * scale) + 1

    def scores(self, x: np.ndarray, norm: float, which: np.ndarray) -> np.ndarray:
        """Exact inner products with the chosen rows."""
        if norm * self.most < 2.0**52:
            return (self.x[which] @ x).astype(np.int64)  # every partial sum is a whole double
        if norm * self.most >= 2.0**62:
            raise OverflowError("a score does not fit 62 bits")
        return self.x[which].astype(np.int64) @ x.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    places = np.arange(len(scores))
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _file_rows(folder: str, name: str) -> Iterator[dict]:
    """The anchors of one file, block by block."""
    import pyarrow.parquet as pq

    with open_input(folder, name) as stream:
        for batch in pq.ParquetFile(stream).iter_batches(BLOCK_ROWS):
            yield batch


def _against_blocks(folder: str, names: list[str], width: int, k: int, compare, schema: pa.Schema):
    """Compare a task's rows, in chunks, with every block of anchors."""
    most_rows = max(1, CHUNK_BYTES // (8 * width))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = Rows(held, width, k)
            for name in names:
                for block in _file_rows(folder, name):
                    found = compare(rows, block)
                    if found:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for part in batches_of(batch, most_rows):
                if held and count + part.num_rows > most_rows:
                    yield from done(held)
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield from done(held)

    return search


def _anchor_arrays(block: pa.RecordBatch, width: int, k: int):
    angles = from_binaries(block.column("angles"), "<f8", k)
    return zip(
        block.column("key").to_pylist(), block.column("vec_id").to_pylist(), block.column("label").to_pylist(),
        from_binaries(block.column("x"), "<i4", width).astype(float), block.column("norm").to_pylist(), np.cos(angles), np.sin(angles),
    )


def _named(place: int) -> int | None:
    return None if place == LAST_ID else int(place)


def _positives(width: int, k: int, wanted: int):
    def compare(rows: Rows, block: pa.RecordBatch) -> list[tuple]:
        out = []
        for key, anchor, label, x, norm, cos, sin in _anchor_arrays(block, width, k):
            begin, end = rows.label_range(label)
            which = np.arange(begin, end)
            which = which[rows.ids[which] != anchor]
            if len(which) > wanted:
                low, high = rows.bounds(cos, sin, norm, which)
                which = which[high >= np.partition(low, len(low) - wanted)[len(low) - wanted]]
            if not len(which):
                continue
            scores = rows.scores(x, norm, which)
            for place in _first(scores, rows.ids[which], wanted).tolist():
                out.append((key, _named(rows.ids[which[place]]), int(scores[place])))
        return out

    return compare


def _negatives(width: int, k: int, wanted: int, window: tuple[int, int]):
    def compare(rows: Rows, block: pa.RecordBatch) -> list[tuple]:
        out = []
        positives = block.column("positives").to_pylist()
        for (key, anchor, label, x, norm, cos, sin), found in zip(_anchor_arrays(block, width, k), positives):
            spans = [(p["place"], -(-window[0] * p["score"] // 100), window[1] * p["score"] // 100) for p in found]
            spans = [s for s in spans if s[1] <= s[2]]
            if not spans:
                continue
            low, high = rows.bounds(cos, sin, norm, slice(None))
            meets = (high >= min(s[1] for s in spans)) & (low <= max(s[2] for s in spans))
            begin, end = rows.label_range(label)
            meets[begin:end] = False
            which = np.flatnonzero(meets)
            which = which[rows.ids[which] != anchor]
            scores = rows.scores(x, norm, which)
            for place, least, most in spans:
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                for i in inside[_first(scores[inside], rows.ids[which[inside]], wanted)].tolist():
                    out.append((key, place, _named(rows.ids[which[i]]), int(scores[i])))
        return out

    return compare


def _write_blocks(spark: SparkSession, anchors: DataFrame, name: str) -> tuple[str, list[str], int]:
    """Anchors in files of about ``BLOCK_ROWS`` rows; the folder, the files' names and the count."""
    count = anchors.count()
    folder = shared_path(spark, name)
    anchors.repartition(max(1, -(-count // BLOCK_ROWS)), "key").write.parquet(folder)
    written = spark.read.parquet(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return folder, sorted(r["file"] for r in written.distinct().collect()), count


def _firsts(found: DataFrame, group: list[str], id_column: str, score: str, most: int, name: str) -> DataFrame:
    """The first rows of each group, numbered from 1 in ``name``."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.col(id_column).asc_nulls_last())
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def hard_negatives(
    rows: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vec_id, label, vector`` rows."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")
    ).where(F.col("label").isNotNull() & whole(F.col("vector")))
    width = common_length(usable, "vector")
    if not width:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("vector") == width)
    directions = references(usable, width)
    k = len(directions)
    path = shared_path(spark, "measured")
    usable.mapInArrow(_measure(width, directions), MEASURED).write.parquet(path)
    measured = spark.read.schema(MEASURED).parquet(path)

    key = F.xxhash64("vec_id", "label", "x").alias("key")
    anchors = measured.where(F.col("vec_id") % anchor_step == 0).select(key, "*").dropDuplicates(["key", "vec_id", "label", "x"])
    folder, names, count = _write_blocks(spark, anchors, "anchors")
    if not count:
        return spark.createDataFrame([], schema)
    stored_anchors = spark.read.parquet(folder)

    pair = pa.schema([("key", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    near = measured.mapInArrow(
        _against_blocks(folder, names, width, k, _positives(width, k, positives), pair), "key long, positive_id long, positive_score long"
    )
    path = shared_path(spark, "positives")
    _firsts(near, ["key"], "positive_id", "positive_score", positives, "place").write.parquet(path)
    chosen = spark.read.parquet(path)
    lists = chosen.groupBy(F.col("key").alias("_key")).agg(  # at most ``positives`` rows a key
        F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("positives")
    )
    wanted = stored_anchors.join(lists, F.col("key") == F.col("_key")).drop("_key")
    folder, names, count = _write_blocks(spark, wanted, "anchors-with-positives")
    if not count:
        return spark.createDataFrame([], schema)

    triple = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    far = measured.mapInArrow(
        _against_blocks(folder, names, width, k, _negatives(width, k, negatives, window), triple),
        "key long, place int, negative_id long, negative_score long",
    )
    ranked = _firsts(far, ["key", "place"], "negative_id", "negative_score", negatives, "rank")
    ids = spark.read.parquet(folder).select(F.col("key").alias("_anchor"), F.col("vec_id").alias("anchor_id"))
    named = chosen.join(ids, F.col("key") == F.col("_anchor")).select(
        F.col("key").alias("_key"), F.col("place").alias("_place"), "anchor_id", "positive_id", "positive_score"
    )
    joined = ranked.join(named, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place")))
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
