"""Compare hit tables by digests of cells; rows are fetched only where digests differ.

A row belongs to one of ``CELLS`` cells by a hash of all its columns, or of
its key.  A digest is the number of rows of a cell and the sums of two
64-bit hashes of its rows, so it does not depend on the order of rows and
counts copies.  Two forms:

* :func:`row_differences` and :func:`column_differences` take any tables and
  read them twice: first for the digests, then only rows of differing cells
  go on to the shuffle.  Tables that are equal exchange digests only.
* :func:`store` keeps a table with its digests as a tree of three levels (one
  root, 256 nodes, 65,536 cells).  :func:`stored_equality` reads two roots;
  :func:`stored_differences` goes down where nodes differ and reads only the
  folders of rows that hold differing cells.

Defined cases: null is a value of its own, apart from the empty text; equal
rows count as often as they occur; two empty tables are equal; further columns
take no part; whole-number types of ``frequency`` do not matter.  Two different
cells pass for equal only if 128 bits agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.operators import reconcile
from termscan.operators.reconcile import HIT_COLUMNS, KEY_COLUMNS, LEFT, RIGHT, row_hash

NODE_BITS, LEVELS = 8, 2
CELLS = 1 << NODE_BITS * LEVELS
ROWS, DIGESTS = "rows", "digests"
SUMS = ["row_count", "first_sum", "second_sum"]
ROW = "term string, repo string, file string, ext string, bucket string, frequency bigint, context string, copies bigint, cell int, node int"
DIGEST = "node int, row_count bigint, first_sum decimal(38,0), second_sum decimal(38,0), level int"


def cell_of(columns: Sequence[str] = HIT_COLUMNS) -> Column:
    return F.pmod(row_hash(columns), F.lit(CELLS)).cast("int")


def _sums(copies: Column) -> list[Column]:
    """Sums as decimals stay exact for any number of rows."""
    hashes = [row_hash(HIT_COLUMNS, seed).cast("decimal(20,0)") for seed in (1, 2)]
    weighted = [F.sum((h * copies.cast("decimal(17,0)")).cast("decimal(38,0)")) for h in hashes]
    return [s.alias(name) for s, name in zip([F.sum(copies), *weighted], SUMS)]


def cell_digests(hits: DataFrame, by: Sequence[str] = HIT_COLUMNS) -> DataFrame:
    """``cell`` and its digest; a row each for the cells that hold rows."""
    return hits.groupBy(cell_of(by).alias("cell")).agg(*_sums(F.lit(1)))


def _unequal(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Keys whose digests differ, of two tables of digests."""
    signed = [t.select(*key, *[(F.col(c) * F.lit(sign)).cast("decimal(38,0)").alias(c) for c in SUMS]) for t, sign in ((left, 1), (right, -1))]
    net = signed[0].unionByName(signed[1]).groupBy(*key).agg(*[F.sum(c).alias(c) for c in SUMS])
    return net.where(" OR ".join(f"{c} <> 0" for c in SUMS)).select(*key)


def _fetched(
    compare: Callable[[DataFrame, DataFrame], DataFrame], left: DataFrame, right: DataFrame, by: Sequence[str]
) -> DataFrame:
    # At most CELLS numbers, whatever the size of the tables.
    cells = F.broadcast(_unequal(cell_digests(left, by), cell_digests(right, by), "cell"))
    sides = [t.select(*HIT_COLUMNS, cell_of(by).alias("cell")).join(cells, "cell", "left_semi") for t in (left, right)]
    return compare(*[side.drop("cell") for side in sides])


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of :func:`reconcile.row_differences`."""
    return _fetched(reconcile.row_differences, left, right, HIT_COLUMNS)


def column_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of :func:`reconcile.column_differences`; rows of one key share a cell."""
    return _fetched(reconcile.column_differences, left, right, KEY_COLUMNS)


def tree(leaves: DataFrame) -> DataFrame:
    """``level, node`` and digest of every node, from the digests of the cells."""
    above = [F.struct(F.lit(level).alias("level"), F.shiftright("cell", NODE_BITS * (LEVELS - level)).alias("node")) for level in range(LEVELS + 1)]
    nodes = leaves.select(F.explode(F.array(*above)).alias("at"), *SUMS)
    return nodes.groupBy("at.level", "at.node").agg(*[F.sum(c).cast(leaves.schema[c].dataType).alias(c) for c in SUMS])


def store(hits: DataFrame, path: str, parts: int | None = None) -> None:
    """Write distinct rows with their ``copies``, in folders by node, and the tree of digests.

    Copies collapse before the shuffle.  Each of ``parts`` tasks (by default as
    many as the session shuffles into) then holds a run of cells, so there
    are at most ``parts`` files more than folders.  The digests are taken from
    the stored rows, so the hits are computed once.
    """
    spark = hits.sparkSession
    parts = min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), CELLS)
    columns = [F.col(c).cast("bigint").alias(c) if c == "frequency" else F.col(c) for c in HIT_COLUMNS]
    rows = hits.select(columns).groupBy(*HIT_COLUMNS).agg(F.count("*").alias("copies")).withColumn("cell", cell_of())
    rows = rows.withColumn("node", F.shiftright("cell", NODE_BITS))
    dealt = rows.repartitionById(parts, F.shiftright(F.col("cell").cast("bigint") * F.lit(parts), NODE_BITS * LEVELS).cast("int"))
    dealt.sortWithinPartitions("node", "cell").write.partitionBy("node").parquet(f"{path}/{ROWS}")
    leaves = _rows(spark, path).groupBy("cell").agg(*_sums(F.col("copies")))
    tree(leaves).write.partitionBy("level").parquet(f"{path}/{DIGESTS}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(f"{path}/{ROWS}")


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(DIGEST).parquet(f"{path}/{DIGESTS}").where(F.col("level") == level)


def stored_equality(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Row counts and whether two stored tables are equal, from their roots alone."""
    roots = _level(spark, left, 0).withColumn("side", F.lit(LEFT)).unionByName(_level(spark, right, 0).withColumn("side", F.lit(RIGHT)))
    one, other = ([F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0)) for c in SUMS] for side in (LEFT, RIGHT))
    same = F.lit(True)
    for ours, theirs in zip(one, other):
        same = same & (ours == theirs)
    return roots.agg(one[0].alias("left_rows"), other[0].alias("right_rows"), same.alias("equal"))


def differing_cells(spark: SparkSession, left: str, right: str) -> list[int]:
    """Cells in which two stored tables differ: from the root down, below differing nodes only."""
    nodes: list[int] = [0]
    for level in range(LEVELS + 1):
        sides = [_level(spark, path, level) for path in (left, right)]
        if level:
            # At most the nodes of one level, which is a fixed number.
            below = F.broadcast(spark.createDataFrame([(n,) for n in nodes], "parent int"))
            sides = [t.join(below, F.shiftright("node", NODE_BITS) == F.col("parent"), "left_semi") for t in sides]
        nodes = sorted(row["node"] for row in _unequal(*sides, "node").collect())
        if not nodes:
            break
    return nodes


def stored_differences(spark: SparkSession, left: str, right: str) -> DataFrame:
    """The rows of :func:`reconcile.row_differences` of two stored tables."""
    cells = differing_cells(spark, left, right)
    nodes = sorted({c >> NODE_BITS for c in cells})
    # At most CELLS numbers.
    wanted = F.broadcast(spark.createDataFrame([(c,) for c in cells], "cell int"))
    sides = [
        _rows(spark, path).where(F.col("node").isin(nodes)).join(wanted, "cell", "left_semi")
        .select(*HIT_COLUMNS, (F.col("copies") * F.lit(sign)).alias("weight"))
        for path, sign in ((left, 1), (right, -1))
    ]
    return reconcile.surplus(sides[0].unionByName(sides[1]))
