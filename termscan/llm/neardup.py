"""Near-duplicate documents: n-gram Jaccard join with Bayesian pruning.

1. Every text becomes its set of five-word shingles (the whole text if it has
   fewer words), a 128-bit key of the set and 128 MinHash values.  Texts with
   equal sets are copies and become one node.
2. Nodes that share one of 32 bands of four values meet in buckets.  Buckets
   with the same members are looked into once; large ones are cut into cells
   of two chunks each, so no task holds an unbounded group.  In a cell the
   MinHash values are compared 16 at a time, and a pair is dropped as soon as
   the posterior probability of reaching the threshold (uniform prior) falls
   below the tolerance.  Only a spanning forest of the surviving pairs leaves
   the cell.
3. Within each component of these forests all pairs are pruned again and the
   rest is verified exactly on shingle sets, in cells of bounded size; what
   leaves is the number of links of each node and again a spanning forest.

A pair at the threshold fails to share a band with probability
(1 - 0.8**4)**32 < 5e-8, and is pruned with about the tolerance.

Defined cases: null and empty texts have no shingles, no links and a class of
their own; equal texts are always linked; null ids are allowed and a class of
null ids only has a null class id; equal ids are separate documents; repeated
rows are copies; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.llm.components import components
from termscan.llm.storage import stored
from termscan.llm.texts import WINDOW_BASES, Chunk, chunks, lean, mix, span_hashes

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
HASHES = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-8
BUCKET_CHUNK = 1024
CELL_DOCUMENTS = 128
CELL_SHINGLES = 200_000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)

SKETCH_SCHEMA = "doc_id long, id long, k1 long, k2 long, n_shingles int, sig binary, text_key long"


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the bounds of each text's."""
    hashes = chunk.word_hashes()
    n_words = chunk.n_words
    text, first = chunk.windows(size)
    length = np.full(len(first), size)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    text = np.concatenate([text, short])
    first = np.concatenate([first, chunk.word_bounds[:-1][short]])
    length = np.concatenate([length, n_words[short]])
    values = span_hashes(hashes, first, first + length, WINDOW_BASES[0])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    text, values = text[new], values[new]
    return values, np.searchsorted(text, np.arange(len(chunk) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values, 16 bits each, a row per text; empty texts have zeros."""
    out = np.zeros((len(bounds) - 1, hashes), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i in range(hashes):
            h = values * _SEEDS[i]
            h ^= h >> np.uint64(29)
            out[full, i] = (np.minimum.reduceat(h, bounds[:-1][full]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(span_hashes(values, bounds[:-1], bounds[1:], base).view(np.int64) for base in WINDOW_BASES)


def _sketcher(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                values, bounds = shingle_sets(chunk, size)
                k1, k2 = _set_keys(values, bounds)
                sig = signatures(values, bounds)
                rows = batch.slice(chunk.first, len(chunk))
                packed = pa.array([row.tobytes() for row in sig], pa.binary())
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds).astype(np.int32)), packed, rows.column(3)],
                    names=["doc_id", "id", "k1", "k2", "n_shingles", "sig", "text_key"],
                )

    return sketch


def least_matches(threshold: Fraction, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """Fewest matches after each step for which a pair is kept.

    With a uniform prior and k of n values equal, the similarity follows
    Beta(k + 1, n - k + 1); it reaches t with the probability that a binomial
    of n + 1 trials of t is at most k.
    """
    t = float(threshold)
    out = []
    for n in range(step, hashes + 1, step):
        tail, k = 0.0, -1
        while tail < tolerance:
            k += 1
            tail += comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k)
        out.append(k)
    return out


def survivors(sig: np.ndarray, one: int, others: np.ndarray, least: list[int], step: int = STEP) -> np.ndarray:
    """Those of ``others`` whose pair with ``one`` is not pruned."""
    matched = np.zeros(len(others), np.int64)
    for i, needed in enumerate(least):
        part = slice(i * step, (i + 1) * step)
        matched = matched + (sig[others, part] == sig[one, part]).sum(1)
        keep = matched >= needed
        if not keep.all():
            others, matched = others[keep], matched[keep]
        if not len(others):
            break
    return others


def spanning_forest(sig: np.ndarray, least: list[int]) -> tuple[list[int], list[int]]:
    """Edges that join all rows connected by surviving pairs, breadth first."""
    left = np.arange(len(sig))
    a, b = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        one = queue.pop()
        found = survivors(sig, one, left, least)
        if len(found):
            a += [one] * len(found)
            b += found.tolist()
            queue += found.tolist()
            left = np.setdiff1d(left, found, assume_unique=True)
    return a, b


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys as one table, from batches sorted by the keys."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        columns = [held.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        start = 0
        for end in change.tolist():
            yield held.slice(start, end - start)
            start = end
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _bucket_forests(least: list[int]):
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for table in groups(batches, ["band", "i", "j"]):
            nodes = table.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            a, b = spanning_forest(_matrix(table.column("sig")), least)
            u += nodes[a].tolist()
            v += nodes[b].tolist()
            if len(u) > 50_000:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return forests


def in_cells(rows: DataFrame, chunks_of: Column, node: str = "node") -> DataFrame:
    """Each row once per cell (i, j) of two chunks that holds its chunk."""
    with_chunk = rows.withColumn("_n", chunks_of).withColumn("_c", F.pmod(F.xxhash64(node), F.col("_n")))
    cell = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_n") - 1),
        lambda other: F.struct(F.least("_c", other).alias("i"), F.greatest("_c", other).alias("j")),
    )
    exploded = with_chunk.withColumn("_cell", F.explode(cell))
    return exploded.select(*rows.columns, F.col("_cell.i").alias("i"), F.col("_cell.j").alias("j"))


def candidate_edges(nodes: DataFrame, tolerance: float, threshold: Fraction) -> DataFrame:
    """Spanning forests of the pairs that share a band and survive pruning."""
    width = 2 * BAND
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(HASHES // BAND)])
    bands = nodes.where("n_shingles > 0").select("node", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(
        F.count("*").alias("size"), F.min("node").alias("_a"), F.max("node").alias("_b"), F.bit_xor(F.xxhash64("node")).alias("_x")
    ).where("size > 1")
    once = shared.groupBy("size", "_a", "_b", "_x").agg(F.min("band").alias("_band")).select("_band", "size")
    members = bands.join(once, F.col("band") == F.col("_band")).select("node", "band", "size")
    cells = in_cells(members, F.ceil(F.col("size") / BUCKET_CHUNK).cast("long")).drop("size")
    sigs = nodes.select(F.col("node").alias("_node"), "sig")
    joined = cells.join(sigs, F.col("node") == F.col("_node")).select("band", "i", "j", "node", "sig")
    spread = joined.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return spread.mapInArrow(_bucket_forests(least_matches(threshold, tolerance)), "u long, v long")


def _shingler(size: int):
    """Replace texts by their shingle sets; rows whose set is not the node's own are dropped."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "total", "members", "node", "copies", "sig"]
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, bounds = shingle_sets(chunk, size)
                k1, k2 = _set_keys(values, bounds)
                rows = batch.slice(chunk.first, len(chunk))
                own = (rows.column("k1").to_numpy() == k1) & (rows.column("k2").to_numpy() == k2)
                which = np.flatnonzero(own)
                taken = rows.take(pa.array(which))
                sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in which.tolist()]
                yield pa.record_batch([*(taken.column(n) for n in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return shingles


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of blocks of a 0/1 matrix."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        low, high = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[owner[low:high], column[low:high] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verifier(least: list[int], threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["root", "i", "j"]):
            node = table.column("node").to_numpy()
            node, first = np.unique(node, return_index=True)  # repeated rows give a node twice
            if len(node) < 2:
                continue
            table = table.take(pa.array(first))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            chunk = table.column("_c").to_numpy()
            copies = table.column("copies").to_numpy()
            sig = _matrix(table.column("sig"))
            candidate = np.zeros((len(node), len(node)), bool)
            for one in range(len(node) - 1):
                others = np.arange(one + 1, len(node))
                if i != j:  # pairs within a chunk belong to the cell of that chunk alone
                    others = others[chunk[others] != chunk[one]]
                if len(others):
                    candidate[one, survivors(sig, one, others, least)] = True
            if not candidate.any():
                continue
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            both = intersections(sets)
            union = size[:, None] + size[None, :] - both
            linked = candidate & (q * both >= p * union)
            linked |= linked.T
            texts, docs = linked.sum(1), linked @ copies
            label = np.arange(len(node))
            while True:  # smallest linked row, until nothing changes
                lower = np.minimum(label, np.where(linked, label[None, :], len(node)).min(1))
                if (lower == label).all():
                    break
                label = lower
            has = np.flatnonzero(texts)
            yield pa.record_batch(
                [pa.array(node[has]), pa.array(node[label[has]]), pa.array(texts[has].astype(np.int64)), pa.array(docs[has].astype(np.int64))],
                names=["u", "v", "texts", "docs"],
            )

    return verify


def verified_links(documents: DataFrame, nodes: DataFrame, candidates: DataFrame, size: int, tolerance: float, threshold: Fraction) -> DataFrame:
    """``u, v, texts, docs``: a node, a node of its class, and its links found in one cell."""
    totals = candidates.join(nodes.select(F.col("node").alias("_n"), "n_shingles"), F.col("node") == F.col("_n"))
    totals = totals.groupBy(F.col("root").alias("_root")).agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members"))
    wanted = candidates.join(totals, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "root", "total", "members")
    wanted = wanted.join(nodes, F.col("_node") == F.col("node"))
    wanted = wanted.select(F.col("id").alias("_id"), "root", "total", "members", "node", "k1", "k2", "copies", "sig")
    texts = documents.join(wanted, F.col("id") == F.col("_id"))
    schema = "root long, total long, members long, node long, copies long, sig binary, shingles binary"
    sets = texts.select("root", "total", "members", "node", "k1", "k2", "copies", "sig", "text").mapInArrow(lean(_shingler(size)), schema)
    chunks_of = F.greatest(F.ceil(F.col("total") / CELL_SHINGLES), F.ceil(F.col("members") / CELL_DOCUMENTS)).cast("long")
    cells = in_cells(sets.withColumn("_n", chunks_of).withColumn("_c", F.pmod(F.xxhash64("node"), F.col("_n"))), F.col("_n"))
    spread = cells.select("root", "i", "j", "_c", "node", "copies", "sig", "shingles").repartition("root", "i", "j")
    spread = spread.sortWithinPartitions("root", "i", "j", "node")
    return spread.mapInArrow(_verifier(least_matches(threshold, tolerance), threshold), "u long, v long, texts long, docs long")


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """``doc_id, id, class_id, keeper_id, n_links, n_text_links, n_shingles``, one row per document.

    ``class_id`` is the smallest doc_id of the documents joined by links,
    ``n_links`` counts the other documents within the threshold (copies too),
    ``n_text_links`` the different shingle sets.  ``id`` is doc_id, or for a
    null id a hash of the text; ``keeper_id`` is the id of the document that
    stands for the class.
    """
    return with_keepers(documents, shingle, threshold, tolerance).drop("text_key", "is_keeper")


def with_keepers(
    documents: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """The same with ``text_key``, a hash of the text, and ``is_keeper``.

    The keeper of a class is the document with the smallest (id, text_key),
    those with a doc_id before those without; rows that repeat it are keepers too.
    """
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    table = documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    sketched = stored(table.mapInArrow(lean(_sketcher(shingle)), SKETCH_SCHEMA), "sketches")
    merged = sketched.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least_doc"), F.min("id").alias("id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "id", "text_key")).alias("first"),
        F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
    )
    nodes = stored(merged.withColumn("node", F.monotonically_increasing_id()), "nodes")
    candidates = stored(components(candidate_edges(nodes, tolerance, threshold)), "candidates")
    links = stored(verified_links(table.select("id", "text"), nodes, candidates, shingle, tolerance, threshold), "links")
    roots = components(links.select("u", "v")).select(F.col("node").alias("_node"), "root")
    counts = links.groupBy(F.col("u").alias("_u")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    labelled = nodes.drop("sig").join(roots, F.col("node") == F.col("_node"), "left").join(counts, F.col("node") == F.col("_u"), "left")
    labelled = labelled.select("k1", "k2", "copies", "least_doc", "first", F.coalesce("root", "node").alias("root"), "texts", "docs")
    least = labelled.groupBy(F.col("root").alias("_root")).agg(
        F.min("least_doc").alias("class_id"), F.min("first").alias("keeper")
    )
    labelled = labelled.join(least, F.col("root") == F.col("_root")).select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "class_id", "keeper",
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"),
    )
    joined = sketched.drop("sig").join(labelled, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    none = F.col("n_shingles") == 0
    return joined.select(
        "doc_id", "id", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.col("id")).otherwise(F.col("keeper.id")).alias("keeper_id"),
        F.when(none, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(none, 0).otherwise(F.col("n_text_links")).cast("long").alias("n_text_links"),
        F.col("n_shingles").cast("long").alias("n_shingles"), "text_key",
        (none | (F.struct(F.col("doc_id").isNull().alias("unnamed"), "id", "text_key") == F.col("keeper"))).alias("is_keeper"),
    )


def one_of_each_class(documents: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The keeper of each class with all its columns, whatever their names.

    Of rows that repeat a keeper's id and text one stays, that with the
    smallest hash of its columns; they meet with partial aggregation, so no
    task gets all of them.
    """
    keepers = with_keepers(documents, shingle, threshold, tolerance).where("is_keeper")
    keepers = keepers.select(F.col("id").alias("_keeper"), F.col("text_key").alias("_keeper_text")).distinct()
    lowered = [c.lower() for c in documents.columns]
    names = [f"_column_{i}" for i in range(len(lowered))]
    renamed = documents.toDF(*names)
    text = F.col(names[lowered.index("text")]).cast("string")
    doc_id = F.col(names[lowered.index("doc_id")]).cast("long")
    keyed = renamed.select(F.coalesce(doc_id, F.xxhash64(text)).alias("_id"), F.xxhash64(text).alias("_text"), F.struct(*names).alias("_row"))
    single = keyed.groupBy("_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = single.join(keepers, (F.col("_id") == F.col("_keeper")) & (F.col("_text") == F.col("_keeper_text")), "left_semi")
    return kept.select("_row.*").toDF(*documents.columns)
