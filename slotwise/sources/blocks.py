"""Files of any size: read block by block, their lines numbered and their records put together across blocks.

Splitters of whole texts need a text in a row.  Here a row is a line.  A block
knows its own lines and which of them begin a record; how many came before it in
its file follows from sums over the blocks, a row each.  A record that crosses
blocks has one number on both sides and so meets in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.functions import text as T
from slotwise.operators.ordered import kept_apart, running
from slotwise.operators.records import RULES


def _before(sums: DataFrame) -> DataFrame:
    """(_s, _b, _start) of sums (source, _block, _n): what the file's earlier blocks add up to."""
    earlier = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line, text, and for the operators here _block, _m) of all lines of the files below a path, numbered from 0 in each file.

    The lines are written once, since where blocks begin may differ between two
    readings.  A line break at a file's end begins no further line.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"), F.regexp_replace("value", "\r$", "").alias("text"))
    own = kept_apart(raw)
    # rows of a block follow each other
    sums = own.groupBy("source", "_block").agg(F.count("*").alias("_n"), F.min("_m").alias("_least"))
    starts = _before(sums).join(sums.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_least"), ["_s", "_b"])
    met = own.join(starts, (F.col("source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return met.select("source", (F.col("_m") - F.col("_least") + F.col("_start")).alias("line"), "text", "_block", "_m")


def _numbered(records: DataFrame, order: str) -> DataFrame:
    """records with seq, their place in their file by that order, however many a file has."""
    placed = running(records.select("source", order), ["source", order], None, "_i")
    least = placed.groupBy(F.col("source").alias("_s")).agg(F.min("_i").alias("_least"))
    seq = placed.join(least, F.col("source") == F.col("_s")).select("source", order, (F.col("_i") - F.col("_least")).cast("int").alias("seq"))
    return records.join(seq, ["source", order])


def by_lines(lines_: DataFrame) -> DataFrame:
    """What records.by_lines gives of whole texts: (source, seq, kind, text, chars) of the lines that aren't blank."""
    kept = kept_apart(lines_.select("source", "line", T.trimmed(F.col("text")).alias("text")).where("text <> ''"))
    return _numbered(kept, "line").select("source", "seq", F.lit("line").alias("kind"), "text", F.length("text").alias("chars"))


def islands(lines_: DataFrame, kind: str, rule: tuple | None = None) -> DataFrame:
    """What records.islands gives of whole texts, for one of its rules: "log", "markdown" or "yaml"."""
    starts, head = rule or RULES[kind]
    marked = kept_apart(lines_.withColumn("_starts", starts(F.col("text")).cast("int")))
    offset = _before(marked.groupBy("source", "_block").agg(F.sum("_starts").alias("_n")))
    within = F.sum("_starts").over(W.partitionBy("source", "_block").orderBy("_m"))
    told = marked.withColumn("_own", within).join(offset, (F.col("source") == F.col("_s")) & (F.col("_block") == F.col("_b"))).withColumn("_record", F.col("_own") + F.col("_start"))
    g = told.groupBy("source", "_record").agg(
        F.min("line").alias("pos"), F.max("line").alias("last"), F.min_by(F.when(F.col("_starts") == 1, F.col("text")), "line").alias("_head"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_ls"))
    text = T.trimmed(F.array_join(F.transform("_ls", lambda x: x["text"]), "\n"))
    records = kept_apart(g.select("source", "_record", "pos", "last", head(F.col("_head")).alias("section"), text.alias("text")).where("text <> ''"))
    out = _numbered(records, "_record")
    return out.select("source", "seq", F.lit(kind).alias("kind"), F.format_string("L%d-%d", F.col("pos") + 1, F.col("last") + 1).alias("locator"), "section", "text", F.length("text").alias("chars"))

