"""Upkeep of a collection: merges, decisions, chains, reports, sampling plans. Nothing here writes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.config import DEFAULT, RELATIONS, Config
from slotwise.functions import text as T
from slotwise.operators import cards as C
from slotwise.operators.ordered import kept_apart

# From where a proposal is sure, and how large a sample is.
SURE = 0.7
MAP_ID = r"\b(mem_\d{5,})\b"
DEFAULT_SAMPLE = 20


# --- merges and decisions ----------------------------------------------------------------------

def merges(cards: DataFrame, ref: str, least: float = SURE) -> DataFrame:
    """(slot, keeper) of conflicts that are merged without asking: repeats of one claim."""
    return C.proposals(cards, ref).where((F.col("action") == "merge") & (F.col("action_confidence") >= least)).select("slot", "keeper")


def auto_merged(cards: DataFrame, ref: str, least: float = SURE) -> DataFrame:
    """Cards after sure merges: the keeper gets bodies, tags and hits of the others, which it supersedes.

    Bodies follow the keeper's own, newest first.  All cards are returned;
    a slot's bodies end up in one card, as the merge asks.
    """
    by = F.col("superseded_by").cast("string") if "superseded_by" in cards.columns else F.lit(None).cast("string")
    own = cards.withColumn("superseded_by", by).join(merges(cards, ref, least).withColumnRenamed("keeper", "_keeper"), "slot", "left")
    part = F.col("_keeper").isNotNull() & (F.col("status") == "active")
    is_keeper = part & (F.col("id") == F.col("_keeper"))
    at = F.coalesce(F.col("valid_from").cast("timestamp"), F.col("recorded_at"))
    parts = own.where(part).groupBy(F.col("_keeper").alias("_k")).agg(
        F.sort_array(F.collect_list(F.struct(is_keeper.alias("first"), at.alias("at"), "num", F.trim("body").alias("body"))), asc=False).alias("_m"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("_tags"), F.sum("hits").alias("_hits"))
    bodies = F.filter(F.transform("_m", lambda x: x["body"]), lambda b: b != "")
    parts = parts.select("_k", F.array_join(bodies, "\n\n").alias("_body"), "_tags", "_hits")
    out = own.join(parts, is_keeper & (F.col("id") == F.col("_k")), "left")
    gone = part & ~is_keeper
    new = {
        "body": F.coalesce("_body", "body"), "tags": F.coalesce("_tags", "tags"), "hits": F.coalesce(F.col("_hits"), F.col("hits").cast("long")),
        "superseded_by": F.when(gone, F.col("_keeper")).otherwise(F.col("superseded_by")),
        "valid_to": F.when(gone, F.coalesce("valid_to", F.to_date(F.lit(ref)))).otherwise(F.col("valid_to")),
        "status": F.when(gone, "superseded").otherwise(F.col("status")),
    }
    return out.withColumns(new).select(*cards.columns, *([] if "superseded_by" in cards.columns else ["superseded_by"]))


def decided(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cards after decisions (slot, action) on their slots; slots without one, and slots with a single card, stay as they are.

    merge keeps the card that says most and appends the others' values and
    bodies; supersede keeps the latest recorded; keep-first the first; dispute
    marks all; drop and skip leave all out.  Ties go to the smaller num.
    """
    d = decisions.select("slot", F.col("action").alias("_a")).dropDuplicates(["slot"])
    said = F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("value", F.lit("")))
    order = F.when(F.col("_a") == "merge", -said).when(F.col("_a") == "supersede", -F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(0)))
    w = W.partitionBy("slot").orderBy(order.asc_nulls_last(), "num")
    # only slots with a decision are ranked
    many = cards.join(d, "slot", "left_semi").groupBy("slot").agg(F.count("*").alias("_n")).where("_n > 1")
    d = d.join(many, "slot")
    mine = cards.join(d, "slot").withColumn("_r", F.row_number().over(w))
    rest = cards.join(d, "slot", "left_anti")
    picks = F.col("_a").isin("merge", "supersede", "keep-first")
    text = F.concat_ws("\n", F.nullif("value", F.lit("")), F.nullif("body", F.lit("")))
    others = mine.where((F.col("_a") == "merge") & (F.col("_r") > 1)).groupBy(F.col("slot").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))).alias("_o"))
    kept = mine.where(~F.col("_a").isin("drop", "skip") & (~picks | (F.col("_r") == 1))).join(others, F.col("slot") == F.col("_s"), "left")
    base = F.coalesce(F.nullif("body", F.lit("")), "value")
    n = (F.col("_n") - 1).cast("string")
    note = F.when((F.col("_a") == "merge") & (F.col("_n") > 1), F.concat(F.lit("> merged "), n, F.lit(" cards of this slot"))).when(F.col("_a") == "supersede", F.concat(F.lit("> supersedes "), n, F.lit(" cards of this slot")))
    absorbed = F.array_join(F.filter(F.transform("_o", lambda x: x["t"]), lambda t: t != ""), "\n\n")
    body = F.when(note.isNull(), F.col("body")).otherwise(F.concat_ws("\n\n", base, F.nullif(absorbed, F.lit("")), note))
    status = F.when(F.col("_a") == "dispute", "disputed").otherwise(F.col("status"))
    return rest.select(*cards.columns).unionByName(kept.withColumns({"body": body, "status": status}).select(*cards.columns))


VERDICTS = ("dispute", "supersede", "merge", "keep", "archive")
# Fixed value: what stands before a decision's note in a body.
NOTE = "\n\n> 裁决记录 "


def _members(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Active and disputed cards of decided slots with their decision and the card that it keeps."""
    d = decisions.select(F.col("slot").alias("_s"), F.col("verdict").alias("_v"), *[(F.col(c) if c in decisions.columns else F.lit(None)).cast("string").alias(f"_{c}") for c in ("winner", "note", "valid_to")]).dropDuplicates(["_s"])
    own = cards.where("status in ('active', 'disputed')").join(d, F.col("slot") == F.col("_s"))
    first = F.first("id").over(W.partitionBy("slot").orderBy("type", "id"))
    return own.withColumn("_keep", F.coalesce(F.nullif("_winner", F.lit("")), first)).withColumn("_in", F.max((F.col("id") == F.col("_keep")).cast("int")).over(W.partitionBy("slot")) == 1)


def resolution_errors(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """(slot, error) of decisions (slot, verdict, and optionally winner) that can't be carried out."""
    m = _members(cards, decisions).groupBy(F.col("slot").alias("_slot")).agg(F.max("_in").alias("_in"))
    told = decisions.join(m, F.col("slot") == F.col("_slot"), "left")
    error = F.when(F.col("_slot").isNull(), "no_members").when(~F.col("verdict").isin(*VERDICTS), "unknown_verdict").when(~F.col("_in") & F.col("verdict").isin("supersede", "merge"), "unknown_winner")
    return told.select("slot", error.alias("error")).where("error is not null")


def resolved(cards: DataFrame, decisions: DataFrame, ref: str) -> DataFrame:
    """Cards after decisions (slot, verdict, and optionally winner, note, valid_to) on their active and disputed cards.

    dispute marks and reopens all; archive puts all away; keep leaves the
    winner active and closes the others without a successor; supersede closes
    them in its favour; merge moreover gives it their bodies, tags and hits.
    Without a winner the first card by type and id is it.  A note goes to the
    end of the winner's body.  Decisions of `resolution_errors` change nothing.
    """
    new = {"superseded_by": "string", "supersedes": "array<string>", "ended_at": "timestamp"}
    have = cards.withColumns({k: F.lit(None).cast(v) for k, v in new.items() if k not in cards.columns})
    at, day = F.lit(ref).cast("timestamp"), F.to_date(F.lit(ref))
    usable = F.col("_v").isin(*VERDICTS) & (F.col("_in") | F.col("_v").isin("dispute", "archive", "keep"))
    m = _members(have, decisions).where(usable)
    # a winner of "keep" that is no member stands for the first one
    first = F.first("id").over(W.partitionBy("slot").orderBy("type", "id"))
    m = m.withColumn("_keep", F.when(F.col("_in"), F.col("_keep")).otherwise(first))
    is_keeper = F.col("id") == F.col("_keep")
    last = F.struct("type", "id")
    g = m.where(F.col("_v").isin("supersede", "merge") & ~is_keeper).groupBy(F.col("_keep").alias("_k")).agg(
        F.array_sort(F.collect_list(F.struct(last.alias("o"), F.col("id").alias("id"), T.trimmed(F.coalesce("body", F.lit(""))).alias("body"), "tags", "hits"))).alias("_others"))
    o = m.join(g, is_keeper & (F.col("id") == F.col("_k")), "left")
    merge, taken = (F.col("_v") == "merge") & is_keeper, F.col("_v").isin("supersede", "merge") & is_keeper
    none = F.lit(None)
    others = F.coalesce("_others", F.array().cast(g.schema["_others"].dataType))
    bodies = F.filter(F.concat(F.array(T.trimmed(F.coalesce("body", F.lit("")))), F.transform(others, lambda x: x["body"])), lambda b: b != "")
    body = F.when(merge, F.array_join(bodies, "\n\n")).otherwise(F.col("body"))
    body = F.when(taken & (F.coalesce("_note", F.lit("")) != ""), F.concat(body, F.lit(NOTE), day.cast("string"), F.lit(": "), F.col("_note"))).otherwise(body)
    ids = F.transform(others, lambda x: x["id"])
    loses = F.col("_v").isin("supersede", "merge", "keep") & ~is_keeper
    columns = {
        "body": body, "tags": F.when(merge, F.array_sort(F.array_distinct(F.concat("tags", F.flatten(F.transform(others, lambda x: x["tags"])))))).otherwise(F.col("tags")),
        "hits": F.when(merge, F.col("hits") + F.aggregate(others, F.lit(0).cast(have.schema["hits"].dataType), lambda a, x: a + x["hits"])).otherwise(F.col("hits")),
        "source": F.when(merge, F.concat("source", F.lit("|merged:"), F.array_join(ids, ","))).otherwise(F.col("source")),
        "supersedes": F.when(taken, F.concat(F.coalesce("supersedes", F.array().cast("array<string>")), ids)).otherwise(F.col("supersedes")),
        "status": F.when(F.col("_v") == "dispute", "disputed").when(F.col("_v") == "archive", "archived").when(loses, "superseded").when(F.col("_v") == "keep", "active").otherwise(F.col("status")),
        "valid_to": F.when(F.col("_v") == "dispute", none).when(loses, F.coalesce("valid_to", F.col("_valid_to").try_cast("date"), day)).otherwise(F.col("valid_to")),
        "ended_at": F.when(F.col("_v") == "dispute", none).when(loses, at).otherwise(F.col("ended_at")),
        "superseded_by": F.when((F.col("_v") == "dispute") | (F.col("_v") == "keep") & loses, none).when(loses, F.col("_keep")).otherwise(F.col("superseded_by")),
    }
    touched = o.withColumns(columns).select(*have.columns)
    rest = have.join(m.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return rest.unionByName(touched)


def archived(cards: DataFrame, ids: DataFrame, ref: str) -> DataFrame:
    """Cards with those of ids (id) archived and closed."""
    hit = cards.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    is_hit = F.col("_id").isNotNull()
    return hit.withColumns({"status": F.when(is_hit, "archived").otherwise(F.col("status")), "valid_to": F.when(is_hit, F.coalesce("valid_to", F.to_date(F.lit(ref)))).otherwise(F.col("valid_to"))}).drop("_id")


def used(cards: DataFrame, uses: DataFrame) -> DataFrame:
    """Cards with the uses (id, at) added to hits; last_hit is the latest use."""
    u = uses.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    had = F.col("last_hit") if "last_hit" in cards.columns else F.lit(None).cast("timestamp")
    out = cards.join(u, F.col("id") == F.col("_id"), "left").withColumns({"hits": F.col("hits").cast("long") + F.coalesce("_n", F.lit(0)), "last_hit": F.greatest(had, F.col("_at"))})
    return out.drop("_id", "_n", "_at")


def chains(cards: DataFrame) -> DataFrame:
    """(id, last, steps, cyclic) of superseded cards: the end of the chain of superseded_by.

    Links double their reach each round, so a chain of n takes log n joins; a
    chain that has no end after reaching farther than there are links is a cycle.
    """
    links = kept_apart(cards.where("superseded_by is not null").select("id", F.col("superseded_by").alias("last"), F.lit(1).cast("long").alias("steps")))
    n = links.count()
    for _ in range(max(1, math.ceil(math.log2(n + 1))) if n else 0):
        far = links.select(F.col("id").alias("_id"), F.col("last").alias("_last"), F.col("steps").alias("_steps"))
        hop = links.join(far, F.col("last") == F.col("_id"), "left")
        open_ = hop.where("_id is not null")
        links = kept_apart(hop.select("id", F.coalesce("_last", "last").alias("last"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
        if open_.isEmpty():
            break
    ends = links.select(F.col("id").alias("_id"))
    return links.join(ends, F.col("last") == F.col("_id"), "left").select("id", "last", "steps", F.col("_id").isNotNull().alias("cyclic"))


# --- reports -----------------------------------------------------------------------------------

def map_refs(maps: DataFrame) -> DataFrame:
    """(map, id) of the ids that map notes (map, text) name."""
    return maps.select("map", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MAP_ID), F.lit(1)))).alias("id"))


def stale_maps(maps: DataFrame, cards: DataFrame) -> DataFrame:
    """(map, id): ids in map notes that no active card has."""
    return map_refs(maps).join(C.active(cards).select("id"), "id", "left_anti").select("map", "id")


def link_ends(cards: DataFrame) -> DataFrame:
    """(id, relation, target) of links, which name the relation before or after the target."""
    parts = cards.select("id", F.explode(F.filter("links", lambda x: F.contains(x, F.lit(":")))).alias("_l")).select("id", F.split_part("_l", F.lit(":"), F.lit(1)).alias("_a"), F.expr("substring(_l, instr(_l, ':') + 1)").alias("_b"))
    first = F.col("_a").isin(*RELATIONS)
    return parts.select("id", F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("relation"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("target"))


def orphan_links(cards: DataFrame) -> DataFrame:
    """(id, target) of active cards' links to ids that no card has."""
    return link_ends(C.active(cards)).where("target <> ''").join(cards.select(F.col("id").alias("target")), "target", "left_anti").select("id", "target")


def overview(cards: DataFrame) -> DataFrame:
    """(measure, key, n): the state of a collection: types, statuses, contested slots, cards to review, subjects, hot cards."""
    part = lambda df, name, key, n: df.select(F.lit(name).alias("measure"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    live = C.active(cards)
    by = lambda df, key: df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    k, n = F.col("_k"), F.col("_n")
    contested = by(live.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> ''"), F.col("slot")).where("_n > 1")
    head = F.when(F.coalesce("subject", F.lit("")) == "", "(none)").otherwise(F.split_part("subject", F.lit(":"), F.lit(1)))
    hot = live.orderBy(F.desc("hits"), "num").limit(10)
    parts = [
        part(cards.agg(F.count("*").alias("_n")), "total", F.lit("all"), n), part(by(cards, F.concat_ws("/", "type", "status")), "type/status", k, n), part(by(cards, F.col("type")), "type", k, n),
        part(by(cards, F.col("status")), "status", k, n), part(contested, "contested", k, n), part(live.where("confidence < 0.5"), "review", F.col("id"), F.lit(1)),
        part(by(live, head), "subject", k, n), part(hot, "hot", F.col("id"), F.col("hits"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def slots(cards: DataFrame, limit: int | None = None) -> DataFrame:
    """(slot, title, n) of active cards, a slot's title being its first card's; at most `limit` of them, by slot."""
    out = C.active(cards).groupBy("slot").agg(F.min_by("title", "num").alias("title"), F.count("*").alias("n"))
    return out if limit is None else out.orderBy("slot").limit(limit)


def heads(cards: DataFrame) -> DataFrame:
    """(head, n, slots) of active cards by the first word of their predicate."""
    return C.active(cards).groupBy(F.split_part("predicate", F.lit("_"), F.lit(1)).alias("head")).agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"))


def library(cards: DataFrame) -> DataFrame:
    """(measure, key, n): cards, active ones, different slots, and cards by type."""
    one = cards.agg(F.count("*").alias("cards"), F.count_if(F.col("status") == "active").alias("active"), F.count_distinct(F.concat_ws("::", "subject", "predicate")).alias("slots"))
    wide = one.select(F.expr("stack(3, 'cards', cards, 'active', active, 'slots', slots) as (measure, n)")).select("measure", F.lit("all").alias("key"), "n")
    return wide.unionByName(cards.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("measure"), "key", "n"))


def doctor(cards: DataFrame, problems: DataFrame) -> DataFrame:
    """(measure, key, n): the library, slots with several cards, statuses, and the problems (path, problem) of its files."""
    by = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    shared = cards.groupBy("slot").agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("n")).select(F.lit("shared_slots").alias("measure"), F.lit("all").alias("key"), "n")
    return library(cards).unionByName(shared).unionByName(by(cards, "status", F.col("status"))).unionByName(by(problems, "problem", F.col("problem")))


def trial_report(sample: DataFrame, pool: int, target: int, extracted: DataFrame | None = None) -> DataFrame:
    """(measure, key, n) of a trial: its sample by type, status and subject, slots, coverage of the pool (4 places), and valid cards of its extraction."""
    head = F.split_part(F.coalesce("subject", F.lit("(none)")), F.lit(":"), F.lit(1))
    by = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    one = lambda df, name, n: df.agg(n.cast("double").alias("n")).select(F.lit(name).alias("measure"), F.lit("all").alias("key"), "n")
    out = by(sample, "type", F.col("type")).unionByName(by(sample, "status", F.col("status"))).unionByName(by(sample, "subject", head))
    out = out.unionByName(one(sample, "slots", F.count_distinct(F.concat_ws("::", "subject", "predicate")))).unionByName(one(sample, "coverage", F.max(F.lit(round(target / pool, 4) if pool else 0.0))))
    if extracted is not None:
        valid = F.count_if((F.coalesce("type", F.lit("")) != "") & (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("predicate", F.lit("")) != ""))
        out = out.unionByName(one(extracted, "extracted", F.count("*"))).unionByName(one(extracted, "valid", valid)).unionByName(by(extracted, "extracted_type", F.col("type")))
    return out


def order_statistics(cards: DataFrame) -> DataFrame:
    """One row: n, total, median, p95 and longest of the bodies' lengths.

    Lengths are counted first: what meets in one place is a row for each length.
    """
    w = W.orderBy("len").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = cards.groupBy(F.length("body").alias("len")).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("len")))
    return h.agg(F.max("n").alias("n"), F.sum(F.col("len") * F.col("c")).alias("total"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 0.95)).alias("p95"), F.max("len").alias("longest"))


def sweep(cards: DataFrame, ref: str, maps: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """(kind, id, detail): what upkeep would do; a dry run, as nothing is written."""
    row = lambda df, kind, detail, key="id": df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), detail.cast("string").alias("detail"))
    idle = C.archive_candidates(cards, ref)
    out = row(C.expired(cards, ref, config), "expiring", F.col("type")).unionByName(row(merges(cards, ref), "mergeable", F.col("slot"), "keeper")).unionByName(row(idle, "archive", F.col("type")))
    if "links" in cards.columns:
        out = out.unionByName(row(orphan_links(cards), "orphan_link", F.col("target")))
    if maps is not None:
        out = out.unionByName(row(stale_maps(maps, cards), "stale_map", F.col("map")))
    return out


def checkup(cards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(measure, key, n): counts by type and status, conflicts by kind, problems by rule, in one table."""
    part = lambda df, name, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    parts = [part(cards, "type", F.col("type")), part(cards, "status", F.col("status")), part(C.conflicts(cards), "conflict", F.col("kind")), part(C.problems(cards, config), "problem", F.col("problem"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_lines(cards: DataFrame, best: int = 5) -> DataFrame:
    """(subject, cards, ord, line) of an index of active cards: subjects by size, under each its most important cards."""
    w = W.partitionBy("subject")
    own = C.active(cards).withColumn("subject", F.coalesce(F.nullif("subject", F.lit("")), F.lit("(none)")))
    ranked = own.withColumn("ord", F.row_number().over(w.orderBy(F.desc("importance"), F.desc("hits"), "num"))).withColumn("cards", F.count("*").over(w)).where(F.col("ord") <= best)
    heads = ranked.where("ord = 1").select("subject", "cards", F.lit(0).alias("ord"), F.format_string("- **%s** (%d)", "subject", "cards").alias("line"))
    return ranked.select("subject", "cards", "ord", F.format_string("  - `%s` %s", "id", "title").alias("line")).unionByName(heads)


def candidates(journal: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, pos, line) of journal lines that could become cards: over 12 characters, no headings."""
    lines = journal.select("source", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", r"^[-* ]+|[-* ]+$", ""))
    out = lines.select("source", "pos", bare.alias("line")).where(F.length("line") > 12).where("line not like '#%'")
    return out if limit is None else out.orderBy("source", "pos").limit(limit)


def duplicate_ids(cards: DataFrame) -> DataFrame:
    return cards.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def largest_number(cards: DataFrame) -> DataFrame:
    """One row: the largest number of an id; the next card takes the one after it."""
    return cards.agg(F.coalesce(F.max(F.regexp_extract("id", r"^mem_(\d+)", 1).try_cast("long")), F.lit(0)).alias("largest"))


# --- sampling plans ----------------------------------------------------------------------------

@dataclass
class Plan:
    """A sample, or the code of what is wrong with the request."""

    code: str | None = None
    rows: DataFrame | None = None
    target: int = 0
    pool: int = 0
    warnings: list[str] = field(default_factory=list)


def _number(x) -> float | None:
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return v if math.isfinite(v) else None


def planned(cards: DataFrame, strategy: str = "random", count=None, ratio=None, scope: str = "active", seed=0) -> Plan:
    """A checked sample of cards; a ratio goes before a count, and too large a count is lowered with a warning."""
    if strategy not in ("random", "stratified", "slot"):
        return Plan("BAD_STRATEGY")
    if scope not in ("active", "all"):
        return Plan("BAD_SCOPE")
    given = lambda x: x is not None and x != ""
    share, number, start = _number(ratio), _number(count) if given(count) else float(DEFAULT_SAMPLE), _number(seed)
    sizes = cards.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("a")).first()
    pool = sizes["a"] if scope == "active" else sizes["n"]
    problem = (
        "NO_CARDS" if not sizes["n"] else "NO_MATCHING" if not pool else
        "BAD_RATIO" if given(ratio) and (share is None or not 0 < share <= 1) else
        "BAD_COUNT" if not given(ratio) and number is None else
        "NO_SAMPLE" if not given(ratio) and number < 1 else
        "BAD_SEED" if start is None else None)
    if problem:
        return Plan(problem, pool=pool)
    asked = math.ceil(pool * share) if given(ratio) else math.floor(number)
    plan = Plan(target=min(asked, pool), pool=pool, warnings=["SAMPLE_CLAMPED"] if asked > pool else [])
    rows = C.active(cards) if scope == "active" else cards
    draw = {"random": C.sampled, "stratified": C.stratified, "slot": C.spread}[strategy]
    plan.rows = draw(rows, plan.target, int(start)).orderBy("id")
    by = {"stratified": "type", "slot": "slot"}.get(strategy)
    if by and plan.rows.select(by).distinct().count() < rows.select(by).distinct().count():
        plan.warnings.append("SAMPLE_COVERAGE")
    return plan


# Fixed values and steps: the published 32-bit generator and the standard shuffle; a seed's numbers
# and permutation must be those of earlier samples, so both functions below are fixed as a whole.
INCREMENT = 0x6D2B79F5


def draws(seed: int, n: int) -> np.ndarray:
    """The first n uniform numbers of a seed; each is a function of its place, so all are made at once."""
    word = np.uint64(0xFFFFFFFF)
    x = (np.uint64(seed & 0xFFFFFFFF or 1) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(INCREMENT)) & word
    mix = ((x ^ (x >> np.uint64(15))) * (x | np.uint64(1))) & word
    mix ^= (mix + ((mix ^ (mix >> np.uint64(7))) * (mix | np.uint64(61)) & word)) & word
    return (mix ^ (mix >> np.uint64(14))).astype(np.float64) / 2.0**32


def shuffled(ids: list, seed: int) -> list:
    """A seed's permutation of a small list (for samples that must equal earlier ones); large tables take keyed orders."""
    out = list(ids)
    for i, u in zip(range(len(out) - 1, 0, -1), draws(seed, max(0, len(out) - 1)), strict=True):
        j = int(u * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
