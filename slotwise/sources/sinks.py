"""What is written: card files, journals, briefs, task packages, snapshots. All refuse in trial mode."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.text import slug
from slotwise.operators import records as R
from slotwise.operators import upkeep as U
from slotwise.sources import layout as L
from slotwise.sources.cards import FENCED, ReadOnly, opened, rendered, write_cards


def _guard(mode: str) -> None:
    if mode == "trial":
        raise ReadOnly("trial mode does not write")


def write_card_files(cards: DataFrame, path: str, mode: str = "write") -> None:
    """Rendered cards as rows (path, text) of JSON lines by type; `read_card_files` gives them back.

    A file per card would be millions of small files; lines keep each card whole.
    """
    _guard(mode)
    rendered(cards).withColumn("type", F.split_part("path", F.lit("/"), F.lit(1))).write.mode("overwrite").partitionBy("type").json(path)


def read_card_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, text string").json(path).select("path", "text")


def append_audit(events: DataFrame, path: str, mode: str = "write") -> None:
    """Events as JSON lines, appended."""
    _guard(mode)
    events.write.mode("append").json(path)


def append_journal(lines: DataFrame, path: str, mode: str = "write") -> None:
    """Lines (at, line) appended as text below their month and day."""
    _guard(mode)
    lines.select(F.date_format("at", "yyyy-MM").alias("month"), F.date_format("at", "dd").alias("day"), F.concat(F.lit("- "), "line").alias("value")).write.mode("append").partitionBy("month", "day").text(path)


def write_brief(cards: DataFrame, path: str, best: int = 5, mode: str = "write") -> None:
    """The index of active cards as Markdown lines in order, subjects with most cards first."""
    _guard(mode)
    U.brief_lines(cards, best).orderBy(F.desc("cards"), "subject", "ord").select("line").write.mode("overwrite").text(path)


def write_task(texts: DataFrame, path: str, budget: float | None = None, mode: str = "write", kind: str = "agent", existing_slots: tuple[str, ...] = ()) -> DataFrame:
    """A package for an external extractor: chunks, all of them as one text, a folder for results, and a manifest with a row a chunk, which is returned.

    texts has (source, text, format); results are read back by `agent.extracted`.
    The package's own file names its kind, "trial" for one from which nothing
    may be written to a collection, and at most 60 slots that are there already.
    """
    _guard(mode)
    spark = texts.sparkSession
    chunks = R.chunks(R.by_rules(texts), budget)
    name = F.concat(slug(F.col("source").cast("string")), F.lit("-"), F.format_string("%04d", "chunk"))
    chunks.withColumn("id", name).write.mode("overwrite").json(f"{path}/chunks")
    done = spark.read.schema("id string, source string, chunk int, record_count long, chars long, text string").json(f"{path}/chunks")
    done.orderBy("id").select(F.concat("text", F.lit("\n\n")).alias("value")).write.mode("overwrite").text(f"{path}/all")
    result = F.concat(F.lit("results/"), "id", F.lit(".result.json"))
    done.select(F.col("id").alias("chunk"), "source", "record_count", "chars", result.alias("result")).write.mode("overwrite").json(f"{path}/manifest")
    fs, at = L._at(spark, f"{path}/results")
    fs.mkdirs(at)
    L.write_file(spark, f"{path}/{L.MANIFEST}", json.dumps({"mode": kind, "existing_slots": list(existing_slots[:60]), "result": 'results/<chunk>.result.json: {"cards": [...]}'}))
    return spark.read.schema("chunk string, source string, record_count long, chars long, result string").json(f"{path}/manifest")


def write_from_task(cards: DataFrame, folder: str, path: str) -> None:
    """Cards of a task's package as card files; refuses if the package is a trial's."""
    write_card_files(cards, path, L.mode_of(cards.sparkSession, folder))


def reindex(spark: SparkSession, folder: str, path: str, mode: str = "write") -> DataFrame:
    """The card table of a folder of card files, made anew; the files are the truth, the table follows."""
    write_cards(opened(spark, folder), path, mode)
    return spark.read.parquet(path)


def snapshot(cards: DataFrame, path: str, stamp: str, mode: str = "write") -> str:
    """A copy below the stamp; an existing one is an error."""
    _guard(mode)
    cards.write.mode("errorifexists").parquet(f"{path}/{stamp}")
    return f"{path}/{stamp}"


def imported(files: DataFrame, day: str, kind: str = "lesson") -> DataFrame:
    """Loose Markdown files (path, text) as cards without ids: the first heading is the title, else the file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.\w+$", "")
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    heading = F.trim(F.regexp_extract(text, r"(?m)^#+(.*)$", 1))
    title = F.coalesce(F.nullif(heading, F.lit("")), stem)
    plain = files.where(F.trim(F.coalesce("text", F.lit(""))) != "").where(~F.col("text").rlike(FENCED))
    return plain.select(
        F.lit(kind).alias("type"), title.alias("title"), F.concat(F.lit("import:"), slug(stem, 24)).alias("subject"), F.lit("imported_document").alias("predicate"), title.alias("value"),
        F.lit("active").alias("status"), F.lit(0.6).alias("confidence"), F.to_date(F.lit(day)).alias("valid_from"), F.concat(F.lit("import:"), name).alias("source"),
        F.array(F.lit("imported")).alias("tags"), text.alias("body"))
