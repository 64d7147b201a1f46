"""Operators over cards: filters, joins, aggregates, windows, lifecycle."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.config import ARCHIVE_IDLE_DAYS, ARCHIVE_IMPORTANCE, CHANGE, DEFAULT, ENRICHMENT, IDENTICAL, NEAR, PROTECTED, RELATIONS, RESTATE, STATUSES, UNKNOWN_TYPE, Config
from slotwise.functions import temporal as D
from slotwise.functions import text as T
from slotwise.operators.ordered import kept_apart, running


# Fixed value: phrases by which a value says that it replaces another.
CHANGED = r"(?i)(不再|改为|换成|改成|已经?上线|已上线|完成|结束|从现在起|no longer|switched to|instead of)"


def newest():
    """Sort order: what became valid or was recorded last comes first."""
    return (F.coalesce(F.col("valid_from").cast("timestamp"), F.col("recorded_at")).desc_nulls_last(), F.col("num").desc())


def active(cards: DataFrame) -> DataFrame:
    return cards.where("status = 'active'")


def as_of(cards: DataFrame, day: str) -> DataFrame:
    """Cards valid on a day."""
    return cards.where(D.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date")))


def current(cards: DataFrame) -> DataFrame:
    """Cards with a flag is_current: active and without an end."""
    return cards.withColumn("is_current", F.coalesce((F.col("status") == "active") & F.col("valid_to").isNull(), F.lit(False)))


def with_id(cards: DataFrame, ids: list[str]) -> DataFrame:
    """The cards of the given ids; for many ids join instead."""
    return cards.where(F.col("id").isin(ids))


def of_types(cards: DataFrame, types: list[str]) -> DataFrame:
    return cards.where(F.col("type").isin(types))


def listed(cards: DataFrame, kind: str | None = None, status: str | None = None, subject: str | None = None, limit: int = 40) -> DataFrame:
    """Cards of a type and status whose subject begins so, by number."""
    for name, value in (("type", kind), ("status", status)):
        cards = cards.where(F.col(name) == value) if value else cards
    if subject:
        cards = cards.where(F.startswith("subject", F.lit(subject)))
    return cards.orderBy("num").limit(limit)


def with_subjects(cards: DataFrame, subjects: list[str]) -> DataFrame:
    """Cards of the subjects in any case."""
    return cards.where(F.lower("subject").isin([s.lower() for s in subjects]))


def malformed(cards: DataFrame) -> DataFrame:
    """One row: active cards without a part of their slot, and all active ones."""
    bad = (F.trim(F.coalesce("subject", F.lit(""))) == "") | (F.trim(F.coalesce("predicate", F.lit(""))) == "")
    return active(cards).agg(F.count_if(bad).alias("malformed"), F.count("*").alias("total"))


def needs_review(cards: DataFrame) -> DataFrame:
    """Disputed cards, and active ones of little confidence."""
    return cards.where("status in ('active', 'disputed') and (status = 'disputed' or confidence < 0.5)")


def by_subject(cards: DataFrame, subjects: list[str]) -> DataFrame:
    """Cards of the subjects, or whose subject contains the first one's part before the colon."""
    return cards.where(F.col("subject").isin(subjects) | F.contains("subject", F.lit(subjects[0].split(":")[0])))


def slotted(cards: DataFrame) -> DataFrame:
    """Active cards with both parts of their slot."""
    return active(cards).where("trim(coalesce(subject, '')) <> '' and trim(coalesce(predicate, '')) <> ''")


def types_table(spark, config: Config = DEFAULT) -> DataFrame:
    """The type dimension, a row for each configured type."""
    return spark.createDataFrame([(k, *v) for k, v in config.types.items()], "type string, ttl_days int, type_importance double, body_limit int, volatile boolean")


def with_type(cards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cards with their type's settings; an unknown type gets the defaults.  The broadcast side has a row per configured type."""
    out = cards.join(F.broadcast(types_table(cards.sparkSession, config)), "type", "left")
    known = F.col("ttl_days").isNotNull().alias("known_type")
    kept = [F.col(c) for c in cards.columns]
    return out.select(*kept, known, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(("ttl_days", "type_importance", "body_limit", "volatile"), UNKNOWN_TYPE, strict=True)])


def conflicts(cards: DataFrame) -> DataFrame:
    """Slots with several active cards: kind, members from the newest, and what to do about them."""
    rows = slotted(cards).withColumn("_at", F.coalesce(F.col("valid_from").cast("timestamp"), F.col("recorded_at")))
    last = F.struct("_at", "num")
    keeper = F.struct(F.length("body"), "recorded_at", -F.col("num"))
    g = rows.groupBy("slot").agg(
        F.count("*").alias("n"), F.size(F.collect_set("digest")).alias("digests"), F.size(F.collect_set("source")).alias("sources"),
        F.max_by("id", last).alias("newest"), F.max_by(F.coalesce(F.when(F.col("value") != "", F.col("value")), "title"), last).alias("claim"), F.max_by("id", keeper).alias("keeper"),
        F.max_by("recorded_at", last).alias("newest_at"), F.min("recorded_at").alias("oldest_at"),
        F.sort_array(F.collect_list(F.struct("_at", "num", "id")), asc=False).alias("_m"),
    ).where("n > 1")
    return g.withColumn("kind", F.when(F.col("digests") < F.col("n"), "duplicate").otherwise("divergent")).withColumn("members", F.array_join(F.transform("_m", lambda m: m["id"]), ",")).drop("_m")


def proposals(cards: DataFrame, ref: str) -> DataFrame:
    """The action proposed for each conflict, with its confidence."""
    c = conflicts(cards)
    at = F.lit(ref).cast("timestamp")
    explicit, restated = F.col("claim").rlike("(?i)" + CHANGE), F.col("claim").rlike("(?i)" + RESTATE)
    recent = (D.age_days(F.col("newest_at"), F.lit(None), at) <= 30) & (D.age_days(F.col("oldest_at"), F.lit(None), at) <= 180)
    same = F.col("sources") == 1
    dup = F.col("kind") == "duplicate"
    sure = (explicit | restated) & same & recent
    action = F.when(dup, "merge").when(sure | (explicit & restated), "supersede").otherwise("escalate")
    confidence = F.when(dup, 0.95).when(sure, 0.75).when(explicit & restated, 0.6).otherwise(0.0)
    return c.withColumn("action", action).withColumn("action_confidence", confidence)


def _values(cards: DataFrame) -> DataFrame:
    """(slot, v, g, n): the different comparable values of each slot, their bigrams, and how many cards have them."""
    v = cards.groupBy("slot", T.comparable(F.col("value")).alias("v")).agg(F.count("*").alias("n"))
    return v.withColumn("g", T.bigrams(F.col("v")))


def _value_pairs(values: DataFrame, least: float = 0.0) -> DataFrame:
    """(slot, va, vb, sim) of different values of a slot that are at least so similar.

    The lengths alone bound a similarity from above, so most pairs of unlike
    lengths are never compared.
    """
    a = values.select("slot", F.col("v").alias("va"), F.col("g").alias("ga"))
    b = values.select("slot", F.col("v").alias("vb"), F.col("g").alias("gb"))
    share = lambda x, y: F.least(x, y) / F.greatest(x, y, F.lit(1))
    grams = share(F.size("ga"), F.size("gb"))
    bound = (0.35 * 2 * grams / (1 + grams) + 0.65) * (0.85 + 0.15 * share(F.length("va"), F.length("vb")))
    pairs = a.join(b, "slot").where((F.col("va") < F.col("vb")) & (bound >= least - 1e-9))
    return pairs.select("slot", "va", "vb", T.similarity_of(F.col("va"), F.col("vb"), F.col("ga"), F.col("gb")).alias("sim")).where(F.col("sim") >= least)


#: Different values of a slot up to which they are compared each with each; beyond, candidates are looked for.
FEW = 1024


def _by_size(values: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Values of slots with few different ones, and of those with many, if there are any."""
    many = values.groupBy("slot").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("slot")
    if many.isEmpty():
        return values, None
    return values.join(many, "slot", "left_anti"), values.join(many, "slot", "left_semi")


def shared_at_least(n: Column, m: Column, least: float) -> Column:
    """How many bigrams values of n and m of them must share to be at least so similar, whatever their lengths."""
    return F.greatest(F.lit(1), F.ceil(F.lit(least) / (0.7 / (n + m) + 0.65 / F.least(n, m)) - 1e-6)).cast("int")


def prefixes(values: DataFrame, least: float) -> DataFrame:
    """(slot, t, i, v, n): the rarest bigrams t of each value, as many of its n as no value that similar can do without, numbered from 0.

    Bigrams are ranked by how many of the slot's values have them.  If two
    values share k bigrams, then they share one of the first n - k + 1.
    """
    each = values.select("slot", "v", F.explode("g").alias("t"))
    often = each.groupBy("slot", "t").agg(F.count("*").alias("f"))
    ranked = each.join(often, ["slot", "t"]).groupBy("slot", "v").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts"))
    n = F.size("ts")
    share = max(0.0, (least - 0.65) / 0.7)
    # the smallest partner that can be so similar at all needs the fewest in common
    smallest = F.greatest(F.lit(1), F.ceil(n * (share / (1 - share)) - 1e-6))
    kept = n - shared_at_least(n, smallest, least) + 1
    return ranked.select("slot", "v", n.alias("n"), F.posexplode(F.slice("ts", F.lit(1), kept)).alias("i", "x")).select("slot", F.col("x.t").alias("t"), "i", "v", "n")


def candidates(a: DataFrame, b: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """(slot, va, vb) of prefix rows that may be at least so similar, each pair once; ordered: of one set, va before vb."""
    left = a.select("slot", "t", F.col("i").alias("ia"), F.col("v").alias("va"), F.col("n").alias("na"))
    right = b.select("slot", "t", F.col("i").alias("ib"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    k = shared_at_least(F.col("na"), F.col("nb"), least)
    fits = (k <= F.least("na", "nb")) & (F.col("ia") <= F.col("na") - k) & (F.col("ib") <= F.col("nb") - k)
    return left.join(right, ["slot", "t"]).where(fits & (F.col("va") < F.col("vb") if ordered else F.col("va") != F.col("vb"))).select("slot", "va", "vb").distinct()


def _compared(pairs: DataFrame, least: float) -> DataFrame:
    sim = T.similarity_of(F.col("va"), F.col("vb"), T.bigrams(F.col("va")), T.bigrams(F.col("vb")))
    return pairs.withColumn("sim", sim).where(F.col("sim") >= least)


def _found_pairs(values: DataFrame, least: float) -> DataFrame:
    """_value_pairs of slots with many values, by their rarest bigrams."""
    rows = prefixes(values, least)
    return _compared(candidates(rows, rows, least, ordered=True), least)


#: Similarities from which the most similar pair of a slot with many values is looked for, one after another.
STEPS = (NEAR, 0.7, 0.4, 0.0)


def slot_similarity(cards: DataFrame) -> DataFrame:
    """(slot, sim): the largest similarity of two cards' values in each slot with several cards.

    Cards of one value are counted, not paired; only different values meet.  In
    slots with many values the most similar pair is looked for from high
    similarities down, and a slot is done with the first step that finds one.
    """
    values = kept_apart(_values(cards))
    same = values.where("n > 1").select("slot", F.when(F.col("v") == "", 0.0).otherwise(1.0).alias("sim"))
    few, many = _by_size(values)
    found = _value_pairs(few).select("slot", "sim").unionByName(same)
    if many is not None:
        # two equal values can't be surpassed
        rest = kept_apart(many.join(same.where("sim = 1"), "slot", "left_anti"))
        for least in STEPS:
            best = kept_apart(_found_pairs(rest, least).groupBy("slot").agg(F.max("sim").alias("sim")))
            found = found.unionByName(best)
            rest = kept_apart(rest.join(best, "slot", "left_anti"))
            if rest.isEmpty():
                break
        # no two values of what is left share anything
        found = found.unionByName(rest.select("slot", F.lit(0.0).alias("sim")).distinct())
    return found.groupBy("slot").agg(F.max("sim").alias("sim"))


def near_pairs(cards: DataFrame, least: float = NEAR, left: str = "num") -> DataFrame:
    """(a, b, sim) of two cards of a slot, the first by number first, whose values are at least so similar."""
    values = kept_apart(_values(cards))
    few, many = _by_size(values)
    near = _value_pairs(few, least).select("slot", "va", "vb", "sim")
    if many is not None:
        near = near.unionByName(_found_pairs(many, least).select("slot", "va", "vb", "sim"))
    same = values.where("n > 1 and v <> ''").select("slot", F.col("v").alias("va"), F.col("v").alias("vb"), F.lit(1.0).alias("sim"))
    both = near.unionByName(same)
    v = cards.select("slot", left, "id", T.comparable(F.col("value")).alias("v"))
    a = v.select("slot", F.col(left).alias("_a"), F.col("id").alias("a"), F.col("v").alias("va"))
    b = v.select("slot", F.col(left).alias("_b"), F.col("id").alias("b"), F.col("v").alias("vb"))
    met = both.join(a, ["slot", "va"]).join(b, ["slot", "vb"]).where("va <> vb or _a < _b")
    first = F.col("_a") < F.col("_b")
    return met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "sim")


def internal_conflicts(cards: DataFrame) -> DataFrame:
    """Slots with several cards by their values: kind, size, largest similarity of a pair, suggestion."""
    v = cards.withColumn("_v", T.comparable(F.col("value")))
    g = v.groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct("_v").alias("values"), F.max(F.coalesce("value", F.lit("")).rlike(CHANGED)).alias("change")).where("n > 1")
    sims = slot_similarity(cards).withColumnRenamed("sim", "similarity")
    s = F.col("similarity")
    action = F.when(s >= NEAR, "merge").when(F.col("change"), "supersede").when(s >= ENRICHMENT, "merge").otherwise("escalate")
    return g.join(sims, "slot").select("slot", "n", F.when(F.col("values") == 1, "duplicate").otherwise("divergent").alias("kind"), "similarity", action.alias("action"))


def _kept_of(batch: DataFrame, least: float) -> DataFrame:
    """Of values (slot, v, num, g), those that no kept value of a smaller number is near to: the first independent set.

    A value without an undecided earlier neighbour stays, its later neighbours
    go, and so on in rounds.
    """
    rows = prefixes(batch, least)
    near = _compared(candidates(rows, rows, least, ordered=True), least)
    of = batch.select("slot", "v", "num")
    a, b = of.withColumnsRenamed({"v": "va", "num": "na"}), of.withColumnsRenamed({"v": "vb", "num": "nb"})
    both = near.join(a, ["slot", "va"]).join(b, ["slot", "vb"])
    swap = F.col("na") > F.col("nb")
    edges = kept_apart(both.select("slot", F.when(swap, F.col("vb")).otherwise(F.col("va")).alias("early"), F.when(swap, F.col("va")).otherwise(F.col("vb")).alias("late")))
    open_, kept = of, None
    while True:
        live = edges.join(open_.select("slot", F.col("v").alias("early")), ["slot", "early"], "left_semi").join(open_.select("slot", F.col("v").alias("late")), ["slot", "late"], "left_semi")
        new = kept_apart(open_.join(live.select("slot", F.col("late").alias("v")), ["slot", "v"], "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        gone = live.join(new.select("slot", F.col("v").alias("early")), ["slot", "early"], "left_semi").select("slot", F.col("late").alias("v"))
        open_ = kept_apart(open_.join(new.select("slot", "v"), ["slot", "v"], "left_anti").join(gone, ["slot", "v"], "left_anti"))
        if open_.isEmpty():
            return kept_apart(kept)


def _first_wins(values: DataFrame, least: float = NEAR, batch: int = 64) -> DataFrame:
    """(slot, v, _lead, _into) of the values (slot, v, num, id) of slots with many: _into null for those that stay.

    The first values of each slot are settled, what is near a kept one of them
    goes, and a larger batch of the rest follows: so a large group of values
    that are all near each other meets one or a few of them and not itself.
    """
    rest = kept_apart(values.withColumn("g", T.bigrams(F.col("v"))))
    ids, told = values.select("slot", "num", F.col("id").alias("_lead")), None
    while not rest.isEmpty():
        first = kept_apart(rest.withColumn("_r", F.row_number().over(W.partitionBy("slot").orderBy("num"))).where(F.col("_r") <= batch).drop("_r"))
        kept = _kept_of(first, least)
        others = rest.join(kept.select("slot", "v"), ["slot", "v"], "left_anti")
        stay = rest.join(kept.select("slot", "v"), ["slot", "v"], "left_semi")
        near = _compared(candidates(prefixes(rest, least).join(stay.select("slot", "v"), ["slot", "v"], "left_semi"), prefixes(rest, least).join(others.select("slot", "v"), ["slot", "v"], "left_semi"), least), least)
        own = near.join(stay.select("slot", F.col("v").alias("va"), F.col("num").alias("na")), ["slot", "va"]).join(others.select("slot", F.col("v").alias("vb"), F.col("num").alias("nb")), ["slot", "vb"])
        into = kept_apart(own.where("na < nb").groupBy("slot", F.col("vb").alias("v")).agg(F.min("na").alias("na")))
        out = stay.select("slot", "v", "num", F.lit(None).cast("long").alias("na")).unionByName(others.join(into, ["slot", "v"]).select("slot", "v", "num", F.col("na").cast("long").alias("na")))
        told = out if told is None else told.unionByName(out)
        rest = kept_apart(others.join(into.select("slot", "v"), ["slot", "v"], "left_anti"))
        batch *= 8
    named = told.join(ids, ["slot", "num"])
    keepers = ids.select("slot", F.col("num").alias("na"), F.col("_lead").alias("_into"))
    return named.join(keepers, ["slot", "na"], "left").select("slot", "v", "_lead", "_into")


def deduplicated(cards: DataFrame) -> DataFrame:
    """Cards in order of num, first wins: reason null (kept), exact or near, and into which card.

    Equal digests go before any comparison, and cards of one value share their
    fate, so only a slot's different values meet.  Few of them are folded in a
    row; of many, `_first_wins` finds those that stay in rounds of joins.  A
    copy of a kept card is exact; a copy of a near one is near, and into the
    same card.  Cards without a value are near nothing.
    """
    first = F.row_number().over(W.partitionBy("digest").orderBy("num"))
    rows = cards.select("id", "num", "slot", T.comparable(F.col("value")).alias("v"), first.alias("_r"), F.first("id").over(W.partitionBy("digest").orderBy("num")).alias("_first"))
    uniq = rows.where("_r = 1")
    values = kept_apart(uniq.where("v <> ''").groupBy("slot", "v").agg(F.min("num").alias("num"), F.min_by("id", "num").alias("id")))
    few, many = _by_size(values)
    grouped = few.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("num", "id", "v", T.bigrams(F.col("v")).alias("g")))).alias("cs"))
    kept = "array<struct<id:string,v:string,g:array<string>>>"
    out = "array<struct<id:string,v:string,into:string>>"
    zero = F.struct(F.array().cast(kept).alias("k"), F.array().cast(out).alias("o"))

    def step(acc, c):
        hit = F.filter(acc["k"], lambda p: T.similarity_of(p["v"], c["v"], p["g"], c["g"]) >= NEAR)
        near = F.size(hit) > 0
        own = F.struct(c["id"].alias("id"), c["v"].alias("v"), c["g"].alias("g"))
        said = F.struct(c["id"].alias("id"), c["v"].alias("v"), F.when(near, F.get(hit, F.lit(0))["id"]).alias("into"))
        return F.struct(F.when(near, acc["k"]).otherwise(F.concat(acc["k"], F.array(own))).alias("k"), F.concat(acc["o"], F.array(said)).alias("o"))

    folded = grouped.select("slot", F.explode(F.aggregate("cs", zero, step, lambda a: a["o"])).alias("x")).select("slot", "x.v", F.col("x.id").alias("_lead"), F.col("x.into").alias("_into"))
    if many is not None:
        folded = folded.unionByName(_first_wins(many))
    # later cards of a kept value are near its first one
    into = F.when(F.col("id") == F.col("_lead"), F.col("_into")).otherwise(F.coalesce("_into", "_lead"))
    told = uniq.join(folded, ["slot", "v"], "left").select("id", "slot", F.when(into.isNotNull(), "near").alias("reason"), into.alias("into"))
    said = told.select(F.col("id").alias("_id"), F.col("reason").alias("_reason"), "into")
    copies = rows.where("_r > 1").select("id", "slot", "_first").join(said, F.col("_first") == F.col("_id"))
    copies = copies.select("id", "slot", F.when(F.col("_reason").isNull(), "exact").otherwise("near").alias("reason"), F.coalesce("into", "_first").alias("into"))
    return told.unionByName(copies)


def against_baseline(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """Incoming cards whose slot the baseline has: best match, similarity, kind and action."""
    new, old = incoming.select("slot", "id", T.comparable(F.col("value")).alias("va")), base.select("slot", "id", "num", T.comparable(F.col("value")).alias("vb"))
    # different values meet, with the first card of each on the baseline's side
    a = new.select("slot", "va").distinct().withColumn("ga", T.bigrams(F.col("va")))
    b = old.groupBy("slot", "vb").agg(F.min("num").alias("old_num"), F.min_by("id", "num").alias("old_id")).withColumn("gb", T.bigrams(F.col("vb")))
    pairs = a.join(b, "slot").select("slot", "va", "old_id", "old_num", T.similarity_of(F.col("va"), F.col("vb"), F.col("ga"), F.col("gb")).alias("similarity"))
    top = pairs.groupBy("slot", "va").agg(F.max(F.struct("similarity", (-F.col("old_num")).alias("_o"), "old_id")).alias("m"))
    # what resembles none of the slot's cards has no best match
    old_id = F.when(F.col("m.similarity") > 0, F.col("m.old_id"))
    best = new.join(top, ["slot", "va"]).select("slot", F.col("id").alias("new_id"), old_id.alias("old_id"), "m.similarity")
    s = F.col("similarity")
    return best.withColumn("kind", F.when(s >= IDENTICAL, "identical").when(s >= ENRICHMENT, "enrichment").otherwise("contradiction"))


def in_order(diff: DataFrame) -> DataFrame:
    """Findings of against_baseline in order: contradictions first, the least similar first, then by slot and card."""
    rank = F.when(F.col("kind") == "contradiction", 0).when(F.col("kind") == "enrichment", 1).otherwise(2)
    return diff.orderBy(rank, "similarity", "slot", "new_id")


def new_slots(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """Slots of incoming cards that the baseline lacks."""
    return incoming.select("slot").join(base.select("slot"), "slot", "left_anti").distinct()


def uncovered(incoming: DataFrame, base: DataFrame) -> DataFrame:
    """(slot, n) of the baseline that no incoming card has."""
    return base.join(incoming.select("slot"), "slot", "left_anti").groupBy("slot").agg(F.count("*").alias("n"))


def truth_table(cards: DataFrame, *within: str) -> DataFrame:
    """(slot, current, members, needs_human) of slots with several active or disputed cards, members from the newest; for each value of the columns `within`.

    Cards count from when they became valid, else from when they were recorded;
    cards without both parts of their slot are in none.
    """
    rows = cards.where("status in ('active', 'disputed') and coalesce(subject, '') <> '' and coalesce(predicate, '') <> ''").withColumn("_at", F.coalesce(F.col("valid_from").cast("timestamp"), F.col("recorded_at")))
    last = F.struct("_at", "num")
    g = rows.groupBy(*within, "slot").agg(F.max_by("id", last).alias("current"), F.sort_array(F.collect_list(F.struct("_at", "num", "id")), asc=False).alias("m"), F.bool_or(F.col("status") == "disputed").alias("needs_human"))
    return g.where(F.size("m") >= 2).select(*within, "slot", "current", F.array_join(F.transform("m", lambda x: x["id"]), ",").alias("members"), "needs_human")


def types_by_count(cards: DataFrame) -> DataFrame:
    """(type, n), the most frequent first."""
    return cards.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


#: Rules of problems whose breach keeps a card from being added.
HARD = ("body_limit", "confidence_range", "importance_range", "subject_space", "predicate_space", "active_ended", "ended_open", "superseded_by_missing")


def problems(cards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(id, problem, hard): a row for each rule that a card breaks; hard ones keep it from being added."""
    c = with_type(cards, config)
    blank = lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) == ""
    rules = [(f"missing_{x}", blank(x)) for x in ("id", "type", "title", "subject", "predicate", "status")]
    rules += [
        ("unknown_type", ~F.col("known_type")), ("unknown_status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("subject_space", F.contains(F.trim("subject"), F.lit(" "))), ("predicate_space", F.contains(F.trim("predicate"), F.lit(" "))),
        ("body_limit", F.length("body") > F.col("body_limit")), ("empty", blank("value") & blank("body")),
        ("confidence_range", ~F.col("confidence").between(0, 1)), ("importance_range", ~F.col("importance").between(0, 1)),
        ("valid_order", F.col("valid_to") < F.col("valid_from")), ("active_ended", (F.col("status") == "active") & F.col("valid_to").isNotNull()),
        ("ended_open", F.col("status").isin("superseded", "expired") & F.col("valid_to").isNull()),
        ("superseded_by_missing", (F.col("status") == "superseded") & (blank("superseded_by") if "superseded_by" in cards.columns else F.lit(True))),
    ]
    if "links" in cards.columns:
        heads = F.transform(F.filter("links", lambda x: F.contains(x, F.lit(":"))), lambda x: F.split_part(x, F.lit(":"), F.lit(1)))
        rules.append(("unknown_relation", F.size(F.array_except(heads, F.array(*map(F.lit, RELATIONS)))) > 0))
    found = F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules]), lambda x: x.isNotNull())
    hard = F.startswith("problem", F.lit("missing_")) | F.col("problem").isin(*HARD)
    return c.select("id", F.explode(found).alias("problem")).withColumn("hard", hard)


def final_check(cards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: cards without any problem, and the others."""
    bad = problems(cards, config).select("id").distinct().withColumn("bad", F.lit(True))
    return cards.select("id").join(bad, "id", "left").agg(F.count_if(F.col("bad").isNull()).alias("ok"), F.count_if(F.col("bad")).alias("rejected"))


def expired(cards: DataFrame, ref: str, config: Config = DEFAULT) -> DataFrame:
    """Active cards past their effective time to live."""
    c = active(with_type(cards, config))
    return c.where(D.age_days(F.col("recorded_at"), F.col("valid_from"), F.lit(ref).cast("timestamp")) > D.effective_ttl(F.col("ttl_days"), F.col("importance")))


def with_expiry(cards: DataFrame, ref: str, config: Config = DEFAULT) -> DataFrame:
    """Cards with the expired ones marked and closed; pure, nothing is written."""
    gone = expired(cards, ref, config).select(F.col("id").alias("_id"))
    out = cards.join(gone, F.col("id") == F.col("_id"), "left")
    is_gone = F.col("_id").isNotNull()
    new = {"status": F.when(is_gone, "expired").otherwise(F.col("status")), "valid_to": F.when(is_gone, F.coalesce("valid_to", F.to_date(F.lit(ref)))).otherwise(F.col("valid_to"))}
    if "ended_at" in cards.columns:
        new["ended_at"] = F.when(is_gone, F.lit(ref).cast("timestamp")).otherwise(F.col("ended_at"))
    return out.withColumns(new).drop("_id")


def archive_candidates(cards: DataFrame, ref: str) -> DataFrame:
    """Active cards of little importance, long unused, of no protected type; none with links or a successor."""
    none = F.lit(None).cast("timestamp")
    idle = D.days_since_hit(F.col("last_hit") if "last_hit" in cards.columns else none, F.col("recorded_at"), F.col("valid_from"), F.lit(ref).cast("timestamp"))
    free = F.lit(True)
    if "links" in cards.columns:
        free &= F.coalesce(F.size("links") == 0, F.lit(True))
    if "superseded_by" in cards.columns:
        free &= F.coalesce("superseded_by", F.lit("")) == ""
    return active(cards).where(~F.col("type").isin(*PROTECTED) & free & (idle > ARCHIVE_IDLE_DAYS) & (F.col("importance") <= ARCHIVE_IMPORTANCE))


def newest_first(cards: DataFrame, alias: str = "rank") -> DataFrame:
    return cards.withColumn(alias, F.row_number().over(W.partitionBy("slot").orderBy(*newest())))


def merged(cards: DataFrame) -> DataFrame:
    """One row a slot: bodies joined in order, tags united, hits summed."""
    g = cards.groupBy("slot").agg(
        F.count("*").alias("n"), F.sum("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("_t"),
        F.array_sort(F.collect_list(F.struct("num", "body"))).alias("_b"))
    bodies = F.filter(F.transform("_b", lambda x: x["body"]), lambda x: x != "")
    return g.select("slot", "n", "hits", F.array_join("_t", ",").alias("tags"), F.array_join(bodies, "\n\n").alias("body"))


def query_tokens(query: str) -> tuple[list[str], list[str]]:
    """(words, CJK characters or pairs of neighbours) that a query is searched by, each once."""
    words = [w.lower() for w in re.findall("[A-Za-z0-9_]+", query)]
    runs = re.findall(T.CJK, query)
    pairs = [p for r in runs for p in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]
    return list(dict.fromkeys(words)), list(dict.fromkeys(pairs))


def tokens_met(text: Column, words: list[str], pairs: list[str]) -> Column:
    """How many of a query's tokens a text has; the query is a literal, the text is looked through as it is."""
    n = F.lit(0)
    if words:
        plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
        n = F.size(F.array_intersect(F.regexp_extract_all(plain, F.lit("[a-z0-9_]+"), F.lit(0)), F.array(*map(F.lit, words))))
    for p in pairs:
        # a single character counts where it stands alone
        met = F.contains(text, F.lit(p)) if len(p) > 1 else text.rlike(f"(?<![一-鿿]){p}(?![一-鿿])")
        n = n + met.cast("int")
    return n


def search(cards: DataFrame, query: str, ref: str, limit: int = 8, config: Config = DEFAULT, include_inactive: bool = False, compat_tag_hit: bool = False) -> DataFrame:
    """The best cards for a query, with every signal; relevance gates the prior.

    A tag counts if it is a token or a part of the query; with compat_tag_hit
    also if it is in lower case, whatever the query.
    """
    rows = cards if include_inactive else active(cards)
    flat = query.lower()
    words, pairs = query_tokens(query)
    total_tokens = len(words) + len(pairs)
    lexical = tokens_met(F.concat_ws(" ", "title", "value", "body", F.array_join("tags", " "), "predicate"), words, pairs) / F.lit(max(1, total_tokens))
    last = F.element_at(F.split(F.split_part("slot", F.lit("::"), F.lit(1)), ":"), -1)
    pred = F.split_part("slot", F.lit("::"), F.lit(2))
    compact = F.lit(re.sub("[_:-]", "", flat))
    exact = F.when((last != "") & F.contains(compact, last), 0.6).otherwise(0.0) + F.when((F.length(pred) > 2) & F.contains(compact, F.replace(pred, F.lit("_"), F.lit(""))), 0.6).otherwise(0.0)
    met = lambda t: F.lower(t).isin([*words, *pairs]) | ((t != "") & F.contains(F.lit(flat), F.lower(t)))
    tag = F.when(F.exists("tags", (lambda t: met(t) | ((t != "") & F.contains(t, F.lower(t)))) if compat_tag_hit else met), 1.0).otherwise(0.0)
    alias = F.lit(0.0)
    if "aliases" in cards.columns:
        joined = F.lower(F.array_join("aliases", " "))
        n = tokens_met(joined, words, pairs)
        alias = F.when(n > 0, F.least(F.lit(1.0), n / F.lit(float(max(1, min(total_tokens, 6)))))).when((joined != "") & F.contains(F.lit(flat), joined), 1.0).otherwise(0.0)
    age = D.age_days(F.col("recorded_at"), F.col("valid_from"), F.lit(ref).cast("timestamp"))
    s = rows.select(alias.alias("alias_hit"), "id", "num", "slot", "status", lexical.alias("lexical"), exact.alias("slot_exact"), tag.alias("tag_hit"), "importance", "confidence",
                    D.recency(age, config.half_life_days).alias("recency"), D.reuse(F.col("hits")).alias("reuse"))
    w = config.weights
    total = lambda names: sum((F.col(x) * w[x] for x in names[1:]), F.col(names[0]) * w[names[0]])
    # what answers nothing has no use for a prior
    s = s.withColumn("relevance", total(["lexical", "slot_exact", "tag_hit", "alias_hit"])).where("relevance > 0")
    s = s.withColumn("prior", total(["importance", "confidence", "recency", "reuse"]))
    penalty = F.element_at(F.create_map(*[F.lit(x) for kv in config.penalties.items() for x in kv]), F.col("status"))
    s = s.withColumn("score", F.col("relevance") * (1 + F.col("prior")) + penalty)
    return s.where("score > 0").orderBy(F.desc("score"), "num").limit(limit)


def term_search(cards: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Active cards by how many of the query's terms they contain, with two points for all of it and half the importance."""
    whole = query.lower()
    terms = [t for t in re.split(r"[\s,.;:!?，。；：、]+", whole) if t]
    lists = [F.array_join(c, " ") for c in ("tags", "aliases") if c in cards.columns]
    hay = F.lower(F.concat_ws(" ", "title", "value", "subject", "predicate", *lists, "body"))
    met = sum((F.contains(hay, F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = met + F.contains(hay, F.lit(whole)).cast("int") * 2 + F.coalesce("importance", F.lit(0.0)) * 0.5
    return active(cards).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "num").limit(limit)


def keyed_order(seed: int, key: Column) -> Column:
    """A pseudorandom sort key that depends on nothing but seed and key."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key).cast("binary"))


def sampled(cards: DataFrame, n: int, seed: int) -> DataFrame:
    return cards.orderBy(keyed_order(seed, F.col("id")), "id").limit(n)


def stratified(cards: DataFrame, n: int, seed: int, by: str = "type") -> DataFrame:
    """n cards shared among the strata by largest remainder; cards without a stratum are one, the last of equals.

    Strata are counted first, a row each; a card's place in its stratum is its
    place in the pseudorandom order, by ranges of it, so that no stratum meets
    in a task.
    """
    counts = kept_apart(cards.groupBy(by).agg(F.count("*").alias("c")))
    total = counts.agg(F.sum("c")).first()[0] or 0
    share = counts.withColumn("x", F.lit(n) * F.col("c") / F.lit(max(1, total))).withColumn("base", F.floor("x"))
    rest = n - (share.agg(F.sum("base")).first()[0] or 0)
    # as many of the largest remainders as cards are left
    more = share.orderBy(F.desc(F.col("x") - F.col("base")), F.col(by).asc_nulls_last()).limit(max(0, rest)).select(F.col(by).alias("_more"), F.lit(1).alias("_one"))
    told = share.join(more, F.col(by).eqNullSafe(F.col("_more")), "left")
    quota = told.select(F.col(by).alias("_by"), F.least(F.col("base") + F.coalesce("_one", F.lit(0)), F.col("c")).alias("quota")).where("quota > 0")
    keyed = cards.withColumn("_key", keyed_order(seed, F.col("id"))).withColumn("_range", F.substring("_key", 1, 3))
    # a stratum's rows by the first digits of their keys: ranges before and after the quota's end are settled by counts
    sizes = keyed.groupBy(F.col(by).alias("_s"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    open_ = before.join(quota, F.col("_s").eqNullSafe(F.col("_by"))).where("_before < quota").select("_s", "_r", (F.col("quota") - F.col("_before")).alias("_left"))
    met = keyed.join(open_, F.col(by).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    place = F.row_number().over(W.partitionBy(by, "_range").orderBy("_key", "id"))
    return met.withColumn("_place", place).where("_place <= _left").select(*cards.columns)


def spread(cards: DataFrame, n: int, seed: int) -> DataFrame:
    """At most one card of a slot, active ones first; then others to fill up."""
    key = keyed_order(seed, F.col("id"))
    ranked = cards.withColumn("_r", F.row_number().over(W.partitionBy("slot").orderBy(F.col("status") != "active", key, "id")))
    return ranked.orderBy(F.col("_r") > 1, key, "id").limit(n).drop("_r")


def assigned_ids(cards: DataFrame, used: DataFrame, start: int) -> DataFrame:
    """cards (ord) with consecutive free ids from start on.

    A card's place counts the free numbers below its own.  Between used numbers
    lie runs of free ones: each run is an interval of places, and a card finds
    its run by the count of used numbers before it, a join of equal keys.
    """
    own = running(cards, ["ord"], None, "_i")
    taken = used.select(F.regexp_extract("id", r"^mem_(\d+)", 1).try_cast("long").alias("k")).where(F.col("k") >= start).distinct()
    # used numbers in order: place p in the run before it means the number start + place + used before
    gaps = running(taken, ["k"], None, "_u").select((F.col("k") - F.lit(start) - F.col("_u")).alias("_place"))
    marks = gaps.groupBy("_place").agg(F.count("*").alias("_n")).where(F.col("_place") >= 0)
    every = own.select(F.col("_i").alias("_place"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_card")).unionByName(marks.withColumn("_card", F.lit(0)))
    before = running(every, ["_place", "_card"], "_n", "_used").where("_card = 1").select(F.col("_place").alias("_j"), "_used")
    return own.join(before, F.col("_i") == F.col("_j")).withColumn("new_id", F.format_string("mem_%05d", F.lit(start) + F.col("_i") + F.col("_used"))).drop("_i", "_j", "_used")
