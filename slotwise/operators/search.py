"""Search of many queries at once, over an inverted index of a collection.

The index is a table: for each card the tokens of its text and of its other
names, which a query's tokens equal, and its tags, names and the parts of its
slot, which stand in a query.  What stands in a query is one of its stretches,
so all of it is joins by equal keys: no card is looked at that shares nothing
with a query, and none that does is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.config import DEFAULT, Config
from slotwise.functions import temporal as D
from slotwise.functions import text as T
from slotwise.operators import cards as C
from slotwise.operators.ordered import kept_apart

#: Kinds of keys: tokens of the text and of the other names; last part of the subject, predicate; tags, all other names.
TOKEN, ALIAS_TOKEN, LAST, PREDICATE, TAG, ALIASES = "token", "alias_token", "last", "predicate", "tag", "aliases"
SUBJECT = r"(?U)[\w-]+:[\w-]+"


def inverted(cards: DataFrame) -> DataFrame:
    """(kind, key, id), each once: what cards are found by.  Written once, it serves any number of searches."""
    aliases = F.lower(F.array_join("aliases", " ")) if "aliases" in cards.columns else F.lit("")
    last = F.element_at(F.split(F.split_part("slot", F.lit("::"), F.lit(1)), ":"), -1)
    predicate = F.split_part("slot", F.lit("::"), F.lit(2))
    keyed = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    text = F.concat_ws(" ", "title", "value", "body", F.array_join("tags", " "), "predicate")
    every = F.concat(
        keyed(TOKEN, T.tokens(text)), keyed(ALIAS_TOKEN, T.tokens(aliases)), keyed(LAST, F.array(last)), keyed(PREDICATE, F.array(F.when(F.length(predicate) > 2, F.replace(predicate, F.lit("_"), F.lit(""))))),
        keyed(TAG, F.coalesce(F.transform("tags", lambda t: F.lower(t)), F.array().cast("array<string>"))), keyed(ALIASES, F.array(aliases)))
    return cards.select("id", F.explode(F.array_distinct(F.filter(every, lambda x: F.coalesce(x["key"] != "", F.lit(False))))).alias("x")).select("x.kind", "x.key", "id")


def query_keys(queries: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """(qid, kind, key), each once, of queries (qid, query): their tokens, and their stretches of the lengths that keys of a kind have."""
    flat = F.lower("query")
    compact = F.regexp_replace(flat, "[_:-]", "")
    # a query is little to read and much to cut up: a small file of queries is more than one task's work
    queries = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism, "qid")
    tokens = queries.select("qid", F.explode(F.array(F.lit(TOKEN), F.lit(ALIAS_TOKEN))).alias("kind"), T.tokens(F.col("query")).alias("ks"))
    out = tokens.select("qid", "kind", F.explode("ks").alias("key"))
    for kind, text in ((LAST, compact), (PREDICATE, compact), (TAG, flat), (ALIASES, flat)):
        if own := lengths.get(kind):
            at = queries.select("qid", text.alias("s"), F.explode(F.array(*map(F.lit, own))).alias("n")).where(F.length("s") >= F.col("n"))
            at = at.select("qid", "s", "n", F.explode(F.sequence(F.lit(1), F.length("s") - F.col("n") + 1)).alias("i"))
            out = out.unionByName(at.select("qid", F.lit(kind).alias("kind"), F.substr("s", F.col("i"), F.col("n")).alias("key")).distinct())
    return out


def search_many(cards: DataFrame, queries: DataFrame, ref: str, limit: int = 8, index: DataFrame | None = None, config: Config = DEFAULT, include_inactive: bool = False) -> DataFrame:
    """(qid, rank, id, score, lexical, slot_exact, tag_hit, alias_hit): for each of queries (qid, query) what `search` finds, the best first.

    index: `inverted` of these cards or of more.  Queries of one qid are one of
    several rows; null and empty queries find nothing.
    """
    rows = cards if include_inactive else C.active(cards)
    index = kept_apart(inverted(rows)) if index is None else index
    had = kept_apart(_had(index))
    # as many numbers as keys have different lengths
    sizes = had.where(F.col("kind").isin(LAST, PREDICATE, TAG, ALIASES)).select("kind", F.length("key").alias("n")).distinct().collect()
    lengths: dict[str, list[int]] = {}
    for r in sizes:
        lengths.setdefault(r["kind"], []).append(r["n"])
    # most stretches are no card's key.  What is cut out of queries is far more than Spark expects of their file: unless
    # it is told how to join, it sends all of it through the driver
    asked = kept_apart(_telling(query_keys(queries, lengths).join(had.hint("merge"), ["kind", "key"], "left_semi")))
    common, ids = _common(index, asked, queries, had)
    counts = lambda own: [F.size(F.array_intersect(own, F.array(*map(F.lit, ids[k])).cast("array<int>"))).alias(k) for k in KINDS]
    w = config.weights
    age = D.age_days(F.col("recorded_at"), F.col("valid_from"), F.lit(ref).cast("timestamp"))
    prior = {"importance": F.col("importance"), "confidence": F.col("confidence"), "recency": D.recency(age, config.half_life_days), "reuse": D.reuse(F.col("hits"))}
    penalty = F.element_at(F.create_map(*[F.lit(x) for kv in config.penalties.items() for x in kv]), F.col("status"))
    of = rows.select("id", "num", sum((x * w[k] for k, x in list(prior.items())[1:]), prior["importance"] * w["importance"]).alias("_prior"), penalty.alias("_penalty"))
    none = F.array().cast("array<int>")
    numbered = lambda df, by: df.join(F.broadcast(common), ["kind", "key"]).groupBy(by).agg(F.sort_array(F.collect_set("_k")).alias("_has"))
    of = kept_apart(of.join(numbered(index, "id"), "id", "left").withColumn("_has", F.coalesce("_has", none)))
    asks = numbered(asked, "qid").withColumnRenamed("_has", "_asks")
    sized = kept_apart(queries.select("qid", F.size(T.tokens(F.col("query"))).alias("_n")).join(asks, "qid", "left").withColumn("_asks", F.coalesce("_asks", none)))

    # cards that share a rare key with a query: all that they share is counted
    few = lambda df: df.join(F.broadcast(common), ["kind", "key"], "left_anti")
    # dealt by cards, as these rows meet the cards next; only a query's best go on
    rare = few(index).join(few(asked).hint("merge"), ["kind", "key"]).repartition("id").groupBy("id", "qid").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in KINDS])
    rare = rare.join(of, "id").join(sized, "qid")
    rare = rare.select("qid", "id", "num", "_prior", "_penalty", "_n", *[(F.col(f"_{c}") + x).alias(c) for c, x in zip(KINDS, counts(F.array_intersect("_has", "_asks")), strict=True)])
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("score", PLACES)), "num"))).where(F.col("rank") <= limit)
    out = ["qid", "id", "num", "score", "lexical", "slot_exact", "tag_hit", "alias_hit"]
    rare = kept_apart(ranked(_scored(rare, w)).select(*out, F.lit(0).alias("_list")))
    # other cards: of those that have the same common keys the best ones by what isn't the query's, for all queries that ask for the same
    best = kept_apart(_best(_best(of.where(F.size("_has") > 0).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))), limit, "_part"), limit).drop("_part"))
    kinds = sized.select("_n", "_asks").distinct().where(F.size("_asks") > 0)
    both = F.array_intersect("_has", "_asks")
    classes = best.select("_has", "_penalty").distinct().crossJoin(kinds).where(F.arrays_overlap("_has", "_asks")).select("_has", "_penalty", "_n", "_asks", *counts(both))
    found = _scored(classes.withColumnRenamed("_has", "_h").withColumnRenamed("_penalty", "_p").join(best, (F.col("_h") == F.col("_has")) & F.col("_p").eqNullSafe(F.col("_penalty"))), w)
    # rare keys take cards out of this list, of which none falls behind by it
    found = found.withColumn("_r", F.row_number().over(W.partitionBy("_n", "_asks").orderBy(F.desc(F.round("score", PLACES)), "num"))).where(F.col("_r") <= limit)
    shared = found.join(sized, ["_n", "_asks"]).select(*out, F.lit(1).alias("_list"))
    # a card of both lists has all that it shares in the first; one that isn't among the first's best is behind them in the second too
    once = rare.unionByName(shared).withColumn("_l", F.min("_list").over(W.partitionBy("qid", "id"))).where("_list = _l")
    return ranked(once).select("qid", "rank", "id", "score", "lexical", "slot_exact", "tag_hit", "alias_hit")


#: Scores equal to so many places are ties; what a card's prior may lack to tie still, at any relevance over a hundred-thousandth.
PLACES, MARGIN = 9, 1e-4
#: Parts in which the cards of the same common keys are looked through first.
PARTS = 64
KINDS = (TOKEN, ALIAS_TOKEN, LAST, PREDICATE, TAG, ALIASES)


def _telling(asked: DataFrame) -> DataFrame:
    """asked without the names that a query also shares a token with: where a token of a card's names is met, the names as a whole don't count.

    Else a name that many cards and many queries have would meet in as many rows as their product.
    """
    own = asked.where(F.col("kind") == ALIAS_TOKEN).groupBy("qid").agg(F.collect_set("key").alias("_own"))
    met = F.coalesce(F.arrays_overlap(T.tokens(F.col("key")), "_own"), F.lit(False))
    return asked.join(own.hint("merge"), "qid", "left").where((F.col("kind") != ALIASES) | ~met).select(*asked.columns)


def _had(index: DataFrame) -> DataFrame:
    """(kind, key, _c): the numbers of cards that have the keys."""
    return index.groupBy("kind", "key").agg(F.count("*").alias("_c"))


def _common(index: DataFrame, asked: DataFrame, queries: DataFrame, had: DataFrame | None = None) -> tuple[DataFrame, dict[str, list[int]]]:
    """(kind, key, _k) of the keys at which more rows would meet than there are cards' keys and queries; and their numbers by kind.

    All other names are never among them: they count only where none of their
    tokens does, and with every other key a card's relevance grows.
    """
    spark = index.sparkSession
    had = _had(index) if had is None else had
    least = (had.agg(F.sum("_c")).first()[0] or 0) // 16 + queries.count()
    often = had.join(asked.groupBy("kind", "key").agg(F.count("*").alias("_q")).hint("merge"), ["kind", "key"]).where((F.col("kind") != ALIASES) & (F.col("_q") > 1) & (F.col("_c") * F.col("_q") > least))
    got = [(r["kind"], r["key"], i) for i, r in enumerate(often.orderBy("kind", "key").collect())]
    return spark.createDataFrame(got, "kind string, key string, _k int"), {k: [i for kind, _, i in got if kind == k] for k in KINDS}


def _scored(s: DataFrame, w: dict[str, float]) -> DataFrame:
    """Rows with numbers of shared keys by kind, with the parts of their relevance and their score, where there is any."""
    n = F.col("_n")
    alias = F.when(F.col(ALIAS_TOKEN) > 0, F.least(F.lit(1.0), F.col(ALIAS_TOKEN) / F.greatest(F.lit(1), F.least(n, F.lit(6))).cast("double"))).otherwise(F.when(F.col(ALIASES) > 0, 1.0).otherwise(0.0))
    slot = F.when(F.col(LAST) > 0, 0.6).otherwise(0.0) + F.when(F.col(PREDICATE) > 0, 0.6).otherwise(0.0)
    s = s.withColumns({"lexical": F.col(TOKEN) / F.greatest(F.lit(1), n), "slot_exact": slot, "tag_hit": F.when(F.col(TAG) > 0, 1.0).otherwise(0.0), "alias_hit": alias}).drop(*KINDS)
    relevance = F.col("lexical") * w["lexical"] + F.col("slot_exact") * w["slot_exact"] + F.col("tag_hit") * w["tag_hit"] + F.col("alias_hit") * w["alias_hit"]
    return s.withColumn("_relevance", relevance).withColumn("score", F.col("_relevance") * (1 + F.col("_prior")) + F.col("_penalty")).where("_relevance > 0 and score > 0")


def _best(cards: DataFrame, limit: int, *within: str) -> DataFrame:
    """Of cards of the same common keys and penalty those that may be among the `limit` best: by prior, then number."""
    same = ["_has", "_penalty", *within]
    ranks = cards.withColumn("_i", F.row_number().over(W.partitionBy(*same).orderBy(F.desc("_prior"), "num"))).withColumn("_e", F.row_number().over(W.partitionBy(*same, "_prior").orderBy("num")))
    last = F.min(F.when(F.col("_i") <= limit, F.col("_prior"))).over(W.partitionBy(*same))
    return ranks.withColumn("_last", last).where((F.col("_prior") >= F.col("_last") - MARGIN) & (F.col("_e") <= limit)).drop("_i", "_e", "_last")


def _named(queries: DataFrame) -> DataFrame:
    """(qid, _subject) of the subjects that queries name as kind:name, lower-cased."""
    return queries.select("qid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(SUBJECT), F.lit(0)), lambda x: F.lower(x)))).alias("_subject"))


#: Queries, and cards, of a subject that meet in one piece of the work, about.
TOGETHER = 1 << 10


def same_slot(cards: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id) of the cards, whatever their status, whose subject a query names as kind:name, in any case.

    A subject's queries stand in lists, which are unpacked behind the join: a row
    of it is about TOGETHER rows of the result.  Lists and cards of a frequent
    subject are dealt in pieces, each part of the cards with each list.
    """
    own, named = cards.select("id", F.lower("subject").alias("_subject")), _named(queries)
    deal = lambda of, into: F.pmod(F.xxhash64(of), F.col(into)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    size = named.groupBy("_subject").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_lists")).join(own.groupBy("_subject").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_parts")), "_subject")
    # in structs a query without a qid is kept
    lists = named.join(size, "_subject").groupBy("_subject", deal("qid", "_lists").alias("_list"), "_parts").agg(F.collect_list(F.struct("qid")).alias("_asked"))
    lists = lists.select("_subject", "_list", every("_parts").alias("_part"), "_asked")
    dealt = own.join(size, "_subject").select("id", "_subject", every("_lists").alias("_list"), deal("id", "_parts").alias("_part")).repartition("_subject", "_list", "_part")
    return dealt.join(lists, ["_subject", "_list", "_part"]).select("id", F.explode("_asked").alias("_q")).select("_q.qid", "id")


def contested(cards: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, slot, current, members, needs_human): the slots with several active or disputed cards among those that a query names, else among what it found.

    A named subject's slots are put together once, however many queries name it.
    """
    named = _named(queries)
    own = cards.withColumn("_subject", F.lower("subject"))
    told = C.truth_table(own.join(named.select("_subject").distinct().hint("merge"), "_subject", "left_semi"), "_subject")
    # a subject that many queries name is dealt in lists of them, each of which meets its slots
    lists = named.groupBy("_subject").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_lists")).hint("merge")
    asks = named.join(lists, "_subject").withColumn("_list", F.pmod(F.xxhash64("qid"), F.col("_lists")).cast("int")).drop("_lists")
    told = told.join(lists, "_subject").withColumn("_list", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1)))
    out = ["qid", "slot", "current", "members", "needs_human"]
    told = told.repartition("_subject", "_list").join(asks.hint("merge"), ["_subject", "_list"]).select(*out)
    has = own.select("_subject").distinct()
    others = found.join(named.join(has.hint("merge"), "_subject", "left_semi").select("qid").distinct().hint("merge"), "qid", "left_anti").select("qid", "id")
    return told.unionByName(C.truth_table(cards.join(others.hint("merge"), "id"), "qid"))
