"""Running numbers and sums over a whole table without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark) -> str:
    """The folder that driver and executors share: the cluster's checkpoint folder, else one in the warehouse.

    On a cluster a warehouse in the driver's own files is none: that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if at.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{at}/.work"


def kept_apart(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the cluster's checkpoint folder, else in the warehouse."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def running(df: DataFrame, order: list[str], weight: str | None, name: str, keep: Callable[[DataFrame], DataFrame] = kept_apart) -> DataFrame:
    """df with, in a new column, the sum of `weight` (or the number) of the rows before each in that order.

    Rows are dealt by ranges of the order; sums are taken within a range, and
    the ranges' own sums, a row each, are added up.  keep writes the dealt rows.
    """
    dealt = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    w = W.partitionBy("_range").orderBy(*order)
    value = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    sums = dealt.groupBy(F.col("_range").alias("_r")).agg(F.sum(value).alias("_n"))
    starts = sums.select("_r", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = dealt.withColumn(name, F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(starts, F.col("_range") == F.col("_r")).withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_r", "_start")


#: Blocks that one task chains.
FAN = 64


def _chain(rows: list[dict], entry: int, before: int) -> tuple[list[tuple[int, int]], int, int]:
    """(entry, before) of each block of a run, and what follows the last."""
    out = []
    for r in rows:
        out.append((entry, before))
        entry, before = r["exits"][entry], r["since"][entry] + (0 if r["reset"] else before)
    return out, entry, before


MAP = "b long, exits array<int>, since array<long>, reset boolean"
MAP_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_())


def chained(maps: DataFrame, n: int) -> DataFrame:
    """(b, entry, before) of blocks 0 to n - 1: where each is entered, from their maps (b, exits, since, reset).

    A block that is entered at e leaves towards its successor's place exits[e],
    and since[e] tells how much it adds to `before`, which it first sets to 0 if
    it resets.  Maps of FAN neighbours are composed into one, round after round,
    until one task can walk through them; then entries are handed down again, so
    that no task sees more than FAN maps.
    """

    def walk(table: pa.Table, entry: int, before: int) -> pa.Table:
        rows = table.sort_by("b").to_pylist()
        found, _, _ = _chain(rows, entry, before)
        return pa.table([pa.array([r["b"] for r in rows], pa.int64()), pa.array([e for e, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64())], ["b", "entry", "before"])

    if n <= FAN:
        return maps.groupBy(F.lit(0).alias("_g")).applyInArrow(lambda t: walk(t, 0, 0), "b long, entry int, before long")

    def composed(table: pa.Table) -> pa.Table:
        rows = table.sort_by("b").to_pylist()
        ends = [_chain(rows, e, 0)[1:] for e in range(len(rows[0]["exits"]))]
        row = ([rows[0]["b"] // FAN], [[e for e, _ in ends]], [[x for _, x in ends]], [any(r["reset"] for r in rows)])
        return pa.table([pa.array(v, k) for v, k in zip(row, MAP_TYPES, strict=True)], ["b", "exits", "since", "reset"])

    group = F.expr(f"b div {FAN}")
    above = chained(kept_apart(maps.groupBy(group).applyInArrow(composed, MAP)), -(-n // FAN))

    def handed(table: pa.Table, up: pa.Table) -> pa.Table:
        return walk(table, up.column("entry")[0].as_py(), up.column("before")[0].as_py())

    return maps.groupBy(group.alias("_g")).cogroup(above.groupBy(F.col("b").alias("_g"))).applyInArrow(handed, "b long, entry int, before long")
