"""What all operators share on Spark's side: tables kept between steps, numbers in an order, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without one, a session on this machine alone gets
    a temporary folder; on a cluster that is an error, as each machine would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def path_of(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path and the path, as Spark's own objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = path_of(spark, path)
    fs.delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder; later steps read the columns that they need of it.

    Tables are removed at the end of the ``tidied`` block that they were made in, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied() -> Iterator[None]:
    """Removes what ``cut`` kept within the block; results have to be written before it ends."""
    had = len(_kept)
    try:
        yield
    finally:
        while len(_kept) > had:
            with suppress(Exception):  # a folder that cannot be removed now is no reason to lose the result
                remove(*_kept.pop())


@atexit.register
def _remove_all() -> None:
    while _kept:
        spark, path = _kept.pop()
        with suppress(Exception):  # the session may have ended first
            remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_order(df: DataFrame, by: list[str], group: str | None = None, size: str | None = None, unique: bool = False) -> DataFrame:
    """df with ``row_no`` (0, 1, ... in the order of ``by``, within ``group`` if given) and ``before`` (sum of size of the rows ahead).

    Rows are kept first, so that they are computed once and each has a place of its own; then they are dealt by range,
    numbered within their range, and shifted by the counts of the ranges ahead. Only those counts, one row for each range
    and group in it, meet in a window of their own. Rows alike in ``by`` are told apart by their place, so no task sees more
    than a range's rows, however many are alike and however large a group is. ``group`` has to lead ``by``. Nulls come first.
    Where no rows are alike in ``by`` (``unique``) and they are cheap to compute twice, they need no place.
    """
    col = lambda c: F.col(f"row.`{c}`")
    placed = df.select(F.struct("*").alias("row"))
    order = [col(c).asc_nulls_first() for c in by]
    if not unique:
        placed = cut(placed.withColumn("place", F.monotonically_increasing_id()))
        order.append(F.col("place").asc())
    dealt = cut(placed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    keys = [F.col("range"), *([col(group)] if group else [])]
    amount = F.coalesce(F.sum(col(size)), F.lit(0)) if size else F.lit(0)
    ahead = Window.partitionBy(F.col("k1") if group else F.lit(0)).orderBy("k0").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), amount.alias("size"))
    shifts = counts.select(*[f"k{i}" for i in range(len(keys))], F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("sizes"))
    within = Window.partitionBy(*keys).orderBy(*order)
    here = F.coalesce(F.sum(col(size)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if size else F.lit(0)
    numbered = dealt.select("*", (F.row_number().over(within) - 1).alias("at"), here.alias("sum"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"k{i}"))
    return numbered.join(shifts, match).select("row.*", (F.col("at") + F.col("rows")).cast("long").alias("row_no"), (F.col("sum") + F.col("sizes")).cast("long").alias("before"))


def _ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is one of the nodes that can be reached, the same for all.

    Rounds of contraction: every node joins the one among itself and its neighbours that comes first in an order by hashes, and
    the graph goes on with those only: a star takes two rounds, a path of n nodes about log n. Only grouped minima
    and joins on nodes are used, so a node with many neighbours is never gathered in one place. At the end the rounds
    are followed backwards.
    """
    rounds: list[DataFrame] = []
    now = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not now.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("n"))
        least = _ways(now).groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["n"].alias("to"))
        least = least.withColumnRenamed("a", "node")
        rounds.append(least)
        ends = now.join(least.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(least.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        now = cut(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop().withColumnRenamed("to", "component")
    while rounds:
        later = found.select(F.col("node").alias("to"), "component")
        found = rounds.pop().join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return found
