"""The card table, bucketed by slot and kept up with the cards that change.

Cards stand in groups of slots, each a partition of the table, and within them
in buckets by slot, so that grouping and joining by slot need no shuffle.  An
update rewrites the groups that it touches and no others.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.ordered import kept_apart
from slotwise.sources.sinks import _guard

#: Partitions of the table, and buckets of each: tasks that a read has.
GROUPS, BUCKETS = 16, 32
GROUP = "slot_group"


def group_of(slot: Column, groups: int = GROUPS) -> Column:
    return F.pmod(F.xxhash64(slot), F.lit(groups)).cast("int")


@contextmanager
def _groups_apart(spark: SparkSession):
    """Within it, overwriting a table replaces the partitions that are written and leaves the others; inserts take this from the session."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def build(cards: DataFrame, name: str, groups: int = GROUPS, buckets: int = BUCKETS, mode: str = "write") -> DataFrame:
    """The table of cards of that name, made anew; one file a group and bucket."""
    _guard(mode)
    own = cards.withColumn(GROUP, group_of(F.col("slot"), groups)).repartition(buckets, "slot")
    own.write.mode("overwrite").partitionBy(GROUP).bucketBy(buckets, "slot").sortBy("slot").saveAsTable(name)
    return table(cards.sparkSession, name)


def table(spark: SparkSession, name: str) -> DataFrame:
    """The cards of a table."""
    return spark.table(name).drop(GROUP)


def update(spark: SparkSession, name: str, changed: DataFrame, removed: DataFrame | None = None, groups: int = GROUPS, buckets: int = BUCKETS, mode: str = "write") -> list[int]:
    """Put changed and new cards (all columns) into a table and take removed ones (id) out; gives the groups that were rewritten.

    Groups are those of the changed cards' slots, and those where cards of
    these ids stand now.  Of changed cards of one id there must be one; cards
    without an id are added.
    """
    _guard(mode)
    have = spark.table(name)
    new = kept_apart(changed.select(*[c for c in have.columns if c != GROUP]).withColumn(GROUP, group_of(F.col("slot"), groups)))
    gone = new.select("id") if removed is None else new.select("id").unionByName(removed.select("id"))
    # numbers of groups, of which there are few; only ids are read for them
    touched = new.select(GROUP).union(have.join(gone, "id", "left_semi").select(GROUP)).distinct()
    at = sorted(r[0] for r in touched.collect())
    if not at:
        return []
    kept = have.where(F.col(GROUP).isin(at)).join(gone, "id", "left_anti").select(*have.columns)
    rows = kept_apart(kept.unionByName(new))
    with _groups_apart(spark):
        rows.repartition(buckets, "slot").write.mode("overwrite").insertInto(name)
    # overwriting leaves a group that has no cards any more as it was
    filled = {r[0] for r in rows.select(GROUP).distinct().collect()}
    if empty := [g for g in at if g not in filled]:
        root = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for g in empty:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{GROUP}={g}"), True)
    spark.catalog.refreshTable(name)
    return at
