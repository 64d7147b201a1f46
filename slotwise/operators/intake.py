"""From loose cards to cards that may be written: normalising, checking, probing for conflicts, forcing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.config import DEFAULT, RELATIONS, STATUSES, TYPES, Config
from slotwise.functions import text as T
from slotwise.operators import cards as C

# Lengths, numbers of entries, defaults, and the mark of a body that was cut off.
SUBJECT, VALUE, TITLE, SOURCE = 80, 300, 120, 120
MOST_ENTRIES, MOST_LINKS = 12, 8
CONFIDENCE = 0.8
BODY_CUT, BODY_ROOM = "\n[内容超长已截断]", 20
DAY = r"^\d{4}-\d{2}-\d{2}$"
GAP = f"[{T.SPACES}]+"
#: Rules of `problems` without which a card is of no use.
REJECTING = ("missing_type", "missing_title", "missing_subject", "missing_predicate", "missing_status", "empty")


def _given(cards: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of that name as text, empty if there is none."""
    return F.col(name).cast(kind) if name in cards.columns else F.lit(None).cast(kind)


def _entries(cards: DataFrame, name: str) -> Column:
    kept = F.filter(F.transform(F.coalesce(_given(cards, name, "array<string>"), F.array().cast("array<string>")), T.trimmed), lambda x: x != "")
    return F.slice(kept, 1, MOST_ENTRIES)


def _share(given: Column, default: Column) -> Column:
    """A number of 0 to 1; the default for what is none."""
    n = given.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


# The sources of imported cards, by a file and by results of an extractor.
IMPORTED, EXTRACTED = "forge:import", "forge:agent"


def normalised(cards: DataFrame, day: str, config: Config = DEFAULT, source: str = IMPORTED) -> DataFrame:
    """Cards with all fields in their form, of loose ones; those without a known type, a slot or a value are left out.

    Columns that are no fields of cards stay; a missing field column is as one
    of nulls.  Long fields are cut, a body with a mark; lists have at most 12
    entries and links of known relations only, at most 8.
    """
    return _formed(cards, day, config, source).where("_usable").drop("_usable")


def _formed(cards: DataFrame, day: str, config: Config, source: str) -> DataFrame:
    """All cards with the fields of `normalised`, and _usable: whether they have a known type, a slot and a value."""
    text = lambda n: T.trimmed(F.coalesce(_given(cards, n), F.lit("")))
    typed = C.with_type(cards, config)
    limit = F.col("body_limit")
    or_else = lambda a, b: F.when(F.coalesce(_given(cards, a), F.lit("")) != "", _given(cards, a)).otherwise(b)
    body = text("body")
    new = {
        "subject": F.substring(F.regexp_replace(text("subject"), GAP, "-"), 1, SUBJECT), "predicate": F.substring(F.regexp_replace(text("predicate"), GAP, "_"), 1, SUBJECT),
        "value": F.substring(T.trimmed(or_else("value", F.coalesce(_given(cards, "title"), F.lit("")))), 1, VALUE),
        "body": F.when(F.length(body) > limit, F.concat(F.substring(body, F.lit(1), limit - BODY_ROOM), F.lit(BODY_CUT))).otherwise(body),
        "status": F.when(_given(cards, "status").isin(*STATUSES), _given(cards, "status")).otherwise("active"),
        "confidence": _share(_given(cards, "confidence"), F.lit(CONFIDENCE)), "importance": _share(_given(cards, "importance"), F.col("type_importance")),
        "valid_from": F.when(_given(cards, "valid_from").rlike(DAY), _given(cards, "valid_from").try_cast("date")).otherwise(F.lit(day).cast("date")),
        "valid_to": F.when(_given(cards, "valid_to").rlike(DAY), _given(cards, "valid_to").try_cast("date")),
        "source": F.substring(or_else("source", F.lit(source)), 1, SOURCE),
        "links": F.slice(F.filter(_entries(cards, "links"), lambda x: F.contains(x, F.lit(":")) & F.split_part(x, F.lit(":"), F.lit(1)).isin(*RELATIONS)), 1, MOST_LINKS),
        "tags": _entries(cards, "tags"), "aliases": _entries(cards, "aliases"), "supersedes": _entries(cards, "supersedes"), "hits": F.lit(0),
    }
    title = F.substring(T.trimmed(or_else("title", new["value"])), 1, TITLE)
    known = F.col("type").isin(*config.types)
    usable = F.coalesce(known & F.expr("subject <> '' and predicate <> '' and value <> ''"), F.lit(False))
    out = typed.withColumns(new | {"title": title}).withColumn("_usable", usable)
    kept = [c for c in cards.columns if c not in (*new, "title")]
    slot = T.slot(F.col("subject"), F.col("predicate"))
    own = out.select(*kept, "title", *new, "_usable").withColumn("slot", slot).withColumn("digest", T.digest(F.col("slot"), F.col("value"), F.col("body")))
    return own.select(*[c for c in own.columns if c != "_usable"], "_usable")


def problems(cards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(id, problem): a row for each of the eleven rules that a card breaks before it is written.

    Unlike the rules of a collection, any white space counts, an id is not
    asked for, and a closed card may do without a successor.  An unknown type
    has the limit of a lesson.
    """
    return C.with_type(cards, config).select("id", F.explode(_broken(config)).alias("problem"))


def _broken(config: Config) -> Column:
    """The names of the rules of `problems` that a card with its type's settings breaks."""
    blank = lambda x: T.trimmed(F.coalesce(F.col(x), F.lit(""))) == ""
    limit = F.when(F.col("known_type"), F.col("body_limit")).otherwise(config.types.get("lesson", TYPES["lesson"])[2])
    rules = [(f"missing_{x}", blank(x)) for x in ("type", "title", "subject", "predicate", "status")]
    rules += [
        ("unknown_type", ~F.col("known_type")), ("unknown_status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("subject_space", F.col("subject").rlike(GAP)), ("predicate_space", F.col("predicate").rlike(GAP)),
        ("body_limit", F.length("body") > limit), ("empty", blank("value") & blank("body")),
        ("confidence_range", ~F.col("confidence").between(0, 1)), ("importance_range", ~F.col("importance").between(0, 1)),
        ("valid_order", F.col("valid_to") < F.col("valid_from")), ("active_ended", (F.col("status") == "active") & F.col("valid_to").isNotNull()),
    ]
    return F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules]), lambda x: x.isNotNull())


def accepted(cards: DataFrame, config: Config = DEFAULT, force: bool = False) -> DataFrame:
    """Cards that may be written: those without problems, with force also those that are only too long."""
    bad = problems(cards, config)
    bad = (bad.where("problem <> 'body_limit'") if force else bad).select(F.col("id").alias("_bad")).distinct()
    return cards.join(bad, F.col("id") == F.col("_bad"), "left_anti")


def read_results(loose: DataFrame, day: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(cards, rejected (id, problems)) of an extractor's cards (id, ...), of `agent.extracted`."""
    # one pass over the extraction: a card's rows meet once, by its id; rows without an id are cards of their own
    formed = _formed(loose, day, config, EXTRACTED)
    kept = [c for c in formed.columns if c not in ("_usable", "problems")]
    own = C.with_type(formed, config).select(*kept, "_usable", F.when(F.col("_usable"), _broken(config)).alias("_broken"))
    card = W.partitionBy("id", F.when(F.col("id").isNull(), F.xxhash64("title", "value", "body")))
    found = F.array_sort(F.flatten(F.collect_list("_broken").over(card)))
    told = own.select(*kept, "_usable", found.alias("problems"), F.max("_usable").over(card).alias("_some"))
    told = told.withColumn("problems", F.when(F.col("id").isNotNull() & (F.size("problems") > 0), F.col("problems")))
    useless = F.coalesce(F.exists("problems", lambda p: p.isin(*REJECTING)), F.lit(False))
    # one branch, so that no card is read twice: what was none, and what is useless
    rejected = told.where(~F.col("_some") | F.col("id").isNull() | (F.col("_usable") & useless))
    why = F.filter(F.array(F.when(~F.col("_some") | F.col("id").isNull(), F.array(F.lit("no_card"))), F.when(F.col("_usable") & useless, F.col("problems"))), lambda x: x.isNotNull())
    return told.where(F.col("_usable") & ~useless).select(*kept, "problems"), rejected.select("id", F.explode(why).alias("problems"))


def added(new: DataFrame, cards: DataFrame, ref: str, config: Config = DEFAULT, force: bool = False) -> DataFrame:
    """(id, ok, problems, existing, action): what happens if each new card is added, each by itself.

    A card with a hard problem is refused unless forced.  If its slot has active
    cards, they are listed with the action that all of them together would get.
    """
    rules = C.problems(new, config).groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list("problem")).alias("problems"), F.max("hard").alias("_hard"))
    held = C.active(cards).where("coalesce(subject, '') <> ''")
    existing = new.select(F.col("id").alias("_new"), "slot").join(held.select("slot", "id"), "slot").groupBy("_new").agg(F.array_sort(F.collect_list("id")).alias("existing"))
    # a group of each new card's own: its slot with the card's id
    fields = ["id", "num", "title", "value", "body", "digest", "source", "recorded_at", "valid_from"]
    mine = new.select(F.col("id").alias("_new"), F.col("slot").alias("_slot"), *fields)
    others = mine.select("_new", "_slot").join(held.select(F.col("slot").alias("_slot"), *fields), "_slot").select("_new", "_slot", *fields)
    both = mine.unionByName(others).withColumn("slot", F.concat_ws("|", "_slot", "_new")).withColumns({"status": F.lit("active"), "subject": F.lit("s"), "predicate": F.lit("p")})
    action = C.proposals(both, ref).select(F.substring_index("slot", "|", -1).alias("_k"), "action")
    out = new.select("id").join(rules, F.col("id") == F.col("_id"), "left").join(existing, F.col("id") == F.col("_new"), "left").join(action, F.col("id") == F.col("_k"), "left")
    ok = F.lit(True) if force else ~F.coalesce("_hard", F.lit(False))
    none = F.array().cast("array<string>")
    return out.select("id", ok.alias("ok"), F.coalesce("problems", none).alias("problems"), F.coalesce("existing", none).alias("existing"), "action")


def export_preview(cards: DataFrame, used: DataFrame, start: int, config: Config = DEFAULT) -> DataFrame:
    """(type, n, ok, first_id, last_id) by type of cards (ord) as they would be numbered and written."""
    numbered = C.assigned_ids(cards, used, start)
    named = numbered.withColumn("id", F.col("new_id"))
    bad = problems(named, config).select(F.col("id").alias("_bad")).distinct()
    told = named.join(bad, F.col("id") == F.col("_bad"), "left")
    return told.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("_bad").isNull()).alias("ok"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
