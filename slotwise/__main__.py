"""Command line over a folder of card files or texts: python -m slotwise COMMAND FOLDER; prints JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.config import TYPES
from slotwise.functions import text as T
from slotwise.operators import agent as A
from slotwise.operators import cards as C
from slotwise.operators import intake as I
from slotwise.operators import records as R
from slotwise.operators import upkeep as U
from slotwise.sources import cards as S
from slotwise.sources import layout as L
from slotwise.sources import sinks


def _listed(cards: DataFrame, a) -> DataFrame:
    for c in ("type", "status"):
        cards = cards.where(F.col(c) == getattr(a, c)) if getattr(a, c) else cards
    return (cards.where(F.startswith("subject", F.lit(a.subject))) if a.subject else cards).orderBy("id").limit(a.limit).select("id", "type", "status", "slot", "title", "value")


def _exported(cards: DataFrame, a) -> DataFrame:
    if a.out:
        sinks.write_brief(cards, a.out)
    return U.brief_lines(cards).orderBy(F.desc("cards"), "subject", "ord").select("line")


#: Commands over cards, as functions of cards and arguments.
CARDS: dict[str, Callable] = {
    "search": lambda c, a: C.search(c if not a.as_of else C.as_of(c, a.as_of), a.query, a.now, a.limit, include_inactive=a.all),
    "terms": lambda c, a: C.term_search(c, a.query, a.limit).select("id", "title", "slot", "value", "type", "score"),
    "list": _listed,
    "show": lambda c, a: S.rendered(c.where(F.col("id") == a.query)),
    "doctor": lambda c, a: U.checkup(c),
    "overview": lambda c, a: U.overview(c),
    "library": lambda c, a: U.library(c),
    "review": lambda c, a: C.needs_review(c).select("id", "title", "type", "status", "confidence"),
    "slots": lambda c, a: U.slots(c, a.limit),
    "template": lambda c, a: S.rendered(C.with_id(c, [a.query]).withColumn("id", F.lit("mem_00000"))),
    "problems": lambda c, a: C.problems(c),
    "conflicts": lambda c, a: C.proposals(c, a.now),
    "gc": lambda c, a: U.sweep(c, a.now),
    "expire": lambda c, a: C.expired(c, a.now).select("id", "type"),
    "stats": lambda c, a: c.rollup("type", "status").agg(F.count("*").alias("n")),
    "export": _exported,
}


def _texts(spark: SparkSession, a) -> DataFrame:
    return S.text_files(spark, a.folder).where("problem is null").select(F.element_at(F.split("path", "/"), -1).alias("source"), "text", S.sniffed(F.col("text"), F.col("path")).alias("format"))


#: Commands over texts, as functions of (source, text, format) and arguments.
TEXTS: dict[str, Callable] = {
    "probe": lambda t, a: S.profile(t).join(t.select("source", "format"), "source"),
    "split": lambda t, a: R.by_rules(t),
    "chunks": lambda t, a: R.numbered_across(R.chunks(R.by_rules(t), a.budget)),
    "task": lambda t, a: sinks.write_task(t, a.out, a.budget),
    "distill": lambda t, a: U.candidates(t, a.limit),
    "import": lambda t, a: sinks.imported(t.withColumnRenamed("source", "path"), a.now[:10]),
}


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))


def _initialised(spark: SparkSession, a) -> DataFrame:
    L.init(spark, a.folder)
    return _one(spark, folder=a.folder, number=L.sequence(spark, a.folder))


def _added(spark: SparkSession, a) -> DataFrame:
    """One card of a JSON object's fields: its problems, what stands in its slot, and its file, written unless it is refused."""
    have = S.opened(spark, a.folder)
    number = max(L.sequence(spark, a.folder), have.agg(F.coalesce(F.max("num"), F.lit(0))).first()[0]) + 1
    loose = A.extracted(spark.createDataFrame([("new", json.dumps([json.loads(a.query)]))], "chunk string, text string")).withColumn("id", F.lit(f"mem_{number:05d}"))
    card = I.normalised(loose, a.now[:10], source="command").withColumn("recorded_at", F.lit(a.now).cast("timestamp"))
    own = card.withColumns({"num": F.lit(number).cast("long"), "slot": T.slot(F.col("subject"), F.col("predicate"))}).withColumn("digest", T.digest(F.col("slot"), F.col("value"), F.col("body")))
    told = I.added(own, have, a.now, force=a.all).first()
    path = None
    if told is not None and told["ok"]:
        (r,) = S.rendered(own).collect()
        path = f"{a.folder}/cards/{r['path']}"
        L.write_file(spark, path, r["text"])
        L.sequence(spark, a.folder, number)
    said = {"id": f"mem_{number:05d}", "ok": path is not None, "path": path, "problems": list(told["problems"]) if told else ["no_card"], "existing": list(told["existing"]) if told else [], "action": told["action"] if told else None}
    return spark.createDataFrame([tuple(said.values())], "id string, ok boolean, path string, problems array<string>, existing array<string>, action string")


def _resolved(spark: SparkSession, a) -> DataFrame:
    """A slot's decision: what is wrong with it, else its cards as they then are; with --out all cards are written there."""
    cards = S.opened(spark, a.folder)
    d = spark.createDataFrame([(a.query, a.verdict, a.winner or None, a.note or None)], "slot string, verdict string, winner string, note string")
    errors = U.resolution_errors(cards, d)
    if not errors.isEmpty():
        return errors
    after = U.resolved(cards, d, a.now)
    if a.out:
        sinks.write_card_files(after, a.out)
    return after.where(F.col("slot") == a.query).select("id", "slot", "status", "valid_to", "superseded_by", "body")


def _logged(spark: SparkSession, a) -> DataFrame:
    sinks.append_journal(spark.createDataFrame([(a.now, a.query)], "at string, line string").select(F.col("at").cast("timestamp"), "line"), a.out or f"{a.folder}/entries")
    return _one(spark, at=a.now, line=a.query)


def _backed_up(spark: SparkSession, a) -> DataFrame:
    return _one(spark, path=sinks.snapshot(S.opened(spark, a.folder), a.out, a.now.replace(" ", "_").replace(":", "-")))


def _status(spark: SparkSession, a) -> DataFrame:
    """The state of each chunk of a task's package: missing, error or ok, and its cards."""
    manifest = spark.read.schema("chunk string, source string, record_count long, chars long, result string").json(f"{a.folder}/manifest")
    fs, at = L._at(spark, f"{a.folder}/results")
    if not fs.exists(at) or not len(fs.listStatus(at)):
        return manifest.select("chunk", F.lit("missing").alias("state"), F.lit(0).alias("cards"))
    files = S.text_files(spark, f"{a.folder}/results").select(F.regexp_extract("path", r"([^/]+)\.result\.json$", 1).alias("chunk"), "text").where("chunk <> ''")
    return A.progress(manifest, A.extracted(files))


#: Commands over a collection's folder or a task's that may write, as functions of the session and arguments.
FOLDERS: dict[str, Callable] = {
    "init": _initialised, "add": _added, "resolve": _resolved, "log": _logged, "backup": _backed_up, "status": _status,
    "reindex": lambda spark, a: sinks.reindex(spark, a.folder, a.out).groupBy("type").agg(F.count("*").alias("n")),
    "validate": lambda spark, a: C.final_check(S.opened(spark, a.folder)),
}


def run(spark: SparkSession, args: list[str]) -> Iterator[str]:
    """JSON lines of a command."""
    p = argparse.ArgumentParser(prog="slotwise", description=__doc__)
    p.add_argument("command", choices=[*CARDS, *TEXTS, *FOLDERS, "types"])
    p.add_argument("folder", nargs="?")
    p.add_argument("query", nargs="?", default="")
    for name in ("type", "status", "subject", "as-of", "out", "verdict", "winner", "note"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--now", default="", help="reference time; the current one if not given")
    p.add_argument("--limit", type=int, default=8)
    p.add_argument("--budget", type=float)
    p.add_argument("--all", action="store_true", help="inactive cards too")
    a = p.parse_args(args)
    a.now = a.now or str(spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0])
    if a.command == "types":
        out = spark.createDataFrame([(k, *v) for k, v in TYPES.items()], "type string, ttl_days int, importance double, body_limit int, volatile boolean")
    elif a.command in FOLDERS:
        out = FOLDERS[a.command](spark, a)
    else:
        out = CARDS[a.command](S.opened(spark, a.folder), a) if a.command in CARDS else TEXTS[a.command](_texts(spark, a), a)
    for r in out.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield r["j"]


if __name__ == "__main__":
    for line in run(SparkSession.builder.appName("slotwise").config("spark.ui.enabled", "false").getOrCreate(), sys.argv[1:]):
        print(line)
