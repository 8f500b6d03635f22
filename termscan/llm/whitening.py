"""Whitening of embeddings: principal components scaled to unit variance.

The entries become integers first, so that counts, sums and deviations are
exact.  Tasks add up the products of centred rows; only the matrix of
dimension x dimension reaches the driver.  There a Cholesky factorisation with
diagonal pivoting gives a triangular factor of full column rank, and one-sided
Jacobi rotations make the columns of that factor orthogonal: their squared
norms are the eigenvalues, the normalised columns the components.  No product
of the factor with itself is formed.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
are dropped, as are vectors of another length than the most frequent one;
null ids and repeated rows count and are returned like any other; there are
only as many components as the covariance has rank, so none at all (no rows)
for an empty table or where all vectors are equal; of equal eigenvalues the
order is that of the rotations; other columns are ignored.  Entries or
deviations that a long cannot hold exactly raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.vectors import PARTIAL_SCHEMA, batches_of, common_length, matrix, partial_rows, summed, whole

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
# Sweeps of rotations at most; a dozen is usual.
SWEEPS = 80
BATCH_ROWS = 2048


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower triangular factor (dimension x rank) of the rows in pivot order, and that order."""
    n = len(a)
    rest = np.diag(a).astype(float).copy()
    order = np.arange(n)
    factor = np.zeros((n, n))
    least = n * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(n):
        pivot = k + int(rest[order[k:]].argmax())
        if rest[order[pivot]] <= least:
            return factor[:, :k], order
        order[[k, pivot]] = order[[pivot, k]]
        factor[[k, pivot]] = factor[[pivot, k]]
        factor[k, k] = np.sqrt(rest[order[k]])
        below = order[k + 1 :]
        factor[k + 1 :, k] = (a[below, order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        rest[below] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together hold every pair of n columns once."""
    players = list(range(n)) + [-1] * (n % 2)
    out = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(p, q) for p, q in zip(players[:half], reversed(players[half:])) if p >= 0 and q >= 0]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The factor times a rotation, with orthogonal columns."""
    columns = factor.T.copy()  # a row each, for contiguous access
    tolerance = np.finfo(float).eps
    rounds = _rounds(len(columns)) if len(columns) > 1 else []
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            a, b = columns[p], columns[q]
            alpha, beta = (a * a).sum(1), (b * b).sum(1)
            gamma = (a * b).sum(1)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a, b = a[turn], b[turn]
            columns[p[turn]] = c[:, None] * a - s[:, None] * b
            columns[q[turn]] = s[:, None] * a + c[:, None] * b
        if not turned:
            break
    return columns.T


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a symmetric matrix in falling order, and unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(a)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    falling = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(rotated)
    vectors[order] = rotated[:, falling] / norms[falling]
    return norms[falling] ** 2, vectors


def integers(values: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """``floor(scale * value) + offset`` as longs."""
    scaled = np.floor(scale * values)
    if len(scaled) and np.abs(scaled).max() >= 2.0**52:
        raise OverflowError("an entry is too large to be counted exactly")
    return scaled.astype(np.int64) + offset


@dataclass(frozen=True)
class Fit:
    """``n`` vectors with sums ``sums``, eigenvalues and components of their covariance, and its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Components over the root of their eigenvalue, as columns."""
        return self.components / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``, rounded once."""
        return (self.n * x - self.sums) / self.n


def _usable(embeddings: DataFrame, vector: str, carry: list[str]) -> tuple[DataFrame, int]:
    rows = embeddings.select(*carry, F.col(vector).cast("array<double>").alias("_vector")).where(whole(F.col("_vector")))
    width = common_length(rows, "_vector")
    return rows.where(F.size("_vector") == width), width


def _adding(width: int, products: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], dtype: str):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        seen = False
        for batch in batches:
            for part in batches_of(batch, BATCH_ROWS):
                total += products(integers(matrix(part.column(0), width)))
                seen = True
        if seen:
            yield partial_rows(total)

    return add


def _sum_over_rows(rows: DataFrame, width: int, products: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], dtype: str) -> np.ndarray:
    partial = rows.select("_vector").mapInArrow(_adding(width, products, shape, dtype), PARTIAL_SCHEMA)
    return summed(partial, *shape, dtype)


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """The components of all rows of ``_vector``, each of ``width`` entries."""

    def counted(x: np.ndarray) -> np.ndarray:
        return np.append(x.sum(0), len(x))[None, :]

    totals = _sum_over_rows(rows, width, counted, (1, width + 1), "<i8")[0]
    n, sums = int(totals[-1]), totals[:-1]
    if n == 0:
        return Fit(0, sums, np.zeros(0), np.zeros((width, 0)), 0.0)

    def scattered(x: np.ndarray) -> np.ndarray:
        y = (n * x - sums) / n
        return y.T @ y

    covariance = _sum_over_rows(rows, width, scattered, (width, width), "<f8") / n
    values, vectors = eigenpairs(covariance)
    return Fit(n, sums, values[:components], vectors[:, :components], float(np.trace(covariance)))


def identity_error(rows: DataFrame, width: int, fitted: Fit) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(fitted.values)
    scaled = fitted.scaled

    def products(x: np.ndarray) -> np.ndarray:
        w = fitted.centred(x) @ scaled
        return np.vstack([w.T @ w, w.sum(0)])

    totals = _sum_over_rows(rows, width, products, (k + 1, k), "<f8") / fitted.n
    mean = totals[k]  # of centred rows: zero but for rounding
    return float(np.abs(totals[:k] - np.outer(mean, mean) - np.eye(k)).max())


def _whitener(width: int, fitted: Fit, error: float):
    k = len(fitted.values)
    scaled, share = fitted.scaled, fitted.values / fitted.trace

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, BATCH_ROWS):
                x = integers(matrix(part.column(1), width))
                apart = fitted.n * x - fitted.sums
                if len(apart) and (apart.astype(float) ** 2).sum(1).max() >= 2.0**63:
                    raise OverflowError("a deviation does not fit a long")
                repeat = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch([
                    part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(repeat), fitted.n)), pa.array((apart * apart).sum(1)[repeat]),
                    pa.array((fitted.centred(x) @ scaled).ravel()), pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(repeat), error)),
                ], names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whiten


def whitened(embeddings: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: ``n, deviation, whitened, explained, identity_error``."""
    rows, width = _usable(embeddings, vector, [F.col(row_id).alias("_id")])
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, width, components) if width else None
    if fitted is None or not len(fitted.values):
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", row_id)
    error = identity_error(rows, width, fitted)
    return rows.select("_id", "_vector").mapInArrow(_whitener(width, fitted, error), schema).withColumnRenamed("_id", row_id)
