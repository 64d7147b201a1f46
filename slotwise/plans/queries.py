"""Every query of the card engine with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.config import PENALTIES, RELATIONS, STATUSES, TYPES, WEIGHTS
from slotwise.functions import temporal as D
from slotwise.functions import text as T
from slotwise.operators import agent as A
from slotwise.operators import cards as C
from slotwise.operators import intake as I
from slotwise.operators import records as R
from slotwise.operators import search as Q
from slotwise.operators import upkeep as U
from slotwise.sources import cards as S
from slotwise.sources.claims import CLAIMS_SQL, REF_TS, claims
from slotwise.streaming import stream as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REF = f"TIMESTAMP '{REF_TS}'"
TYPES_SQL = "types(type, ttl_days, type_importance, body_limit, volatile) AS (VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {str(v[3]).lower()})" for k, v in TYPES.items()) + ")"
AGE_SQL = f"greatest(0.0, (epoch({REF}) - epoch(recorded_at)) / 86400.0)"
COMPARABLE_SQL = r"regexp_replace(lower(coalesce(value, '')), '[\s\p{Z}\p{P}\p{S}]', '', 'g')"
GRAMS_SQL = "CASE WHEN length(v) = 0 THEN [] WHEN length(v) = 1 THEN [v] ELSE list_distinct(list_transform(range(1, length(v)), lambda i: substr(v, i, 2))) END"
QUERY = "click by 42 on k1 card, reply-style of team all"


def query(sql: str | None = None, cte: str | None = CLAIMS_SQL):
    """Register a function of (spark, sf_dir); sql goes after the common table expressions of cte."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{cte or ''} {sql}"
        return f

    return add


def sim_sql(a: str, b: str) -> str:
    """SQL of the similarity of comparable texts a.v, b.v with bigrams a.g, b.g."""
    both = f"len(list_intersect({a}.g, {b}.g))::DOUBLE"
    return (f"CASE WHEN {a}.v = '' OR {b}.v = '' THEN 0.0 WHEN {a}.v = {b}.v THEN 1.0 ELSE least(1.0, (0.35 * ((2 * {both}) / (len({a}.g) + len({b}.g))) + 0.65 * ({both} / least(len({a}.g), len({b}.g))))"
            f" * (0.85 + 0.15 * (least(length({a}.v), length({b}.v))::DOUBLE / greatest(length({a}.v), length({b}.v))))) END")


VALUES_SQL = f", vals AS (SELECT *, {COMPARABLE_SQL} AS v FROM claims), grams AS (SELECT *, {GRAMS_SQL} AS g FROM vals)"


# --- filters ---------------------------------------------------------------------------------

@query("SELECT id, slot, type FROM claims WHERE status = 'active'")
def f1_active(spark, sf_dir):
    return C.active(claims(spark, sf_dir)).select("id", "slot", "type")


@query("SELECT id, slot FROM claims WHERE status = 'active' AND (valid_from IS NULL OR valid_from <= DATE '2024-01-15') AND (valid_to IS NULL OR valid_to > DATE '2024-01-15')")
def f2_as_of(spark, sf_dir):
    return C.as_of(C.active(claims(spark, sf_dir)), "2024-01-15").select("id", "slot")


@query("SELECT id, type FROM claims WHERE type IN ('decision', 'lesson')")
def f3_types(spark, sf_dir):
    return C.of_types(claims(spark, sf_dir), ["decision", "lesson"]).select("id", "type")


@query("SELECT id, subject FROM claims WHERE subject IN ('team:all', 'user:42') OR contains(subject, 'team')")
def f4_subjects(spark, sf_dir):
    return C.by_subject(claims(spark, sf_dir), ["team:all", "user:42"]).select("id", "subject")


@query("SELECT id, subject FROM claims WHERE type = 'episode' AND status = 'active' AND starts_with(subject, 'user:1') ORDER BY num LIMIT 40")
def f5_list(spark, sf_dir):
    return C.listed(claims(spark, sf_dir), "episode", "active", "user:1", 40).select("id", "subject")


@query("SELECT id FROM claims WHERE lower(subject) IN ('user:7', 'user:8')")
def f6_subjects_any_case(spark, sf_dir):
    return C.with_subjects(claims(spark, sf_dir), ["User:7", "user:8"]).select("id")


@query("SELECT count(*) FILTER (trim(coalesce(subject, '')) = '' OR trim(coalesce(predicate, '')) = '') AS malformed, count(*) AS total FROM claims WHERE status = 'active'")
def f7_malformed(spark, sf_dir):
    return C.malformed(claims(spark, sf_dir))


PROBLEMS_SQL = f""", {TYPES_SQL}, checked AS (SELECT c.*, t.type AS known, coalesce(t.body_limit, 1200) AS lim FROM claims c LEFT JOIN types t USING (type)),
problems AS (
 SELECT id, 'unknown_type' AS problem FROM checked WHERE known IS NULL UNION ALL SELECT id, 'unknown_status' FROM checked WHERE status NOT IN {STATUSES}
 UNION ALL SELECT id, 'subject_space' FROM checked WHERE contains(trim(subject), ' ') UNION ALL SELECT id, 'predicate_space' FROM checked WHERE contains(trim(predicate), ' ')
 UNION ALL SELECT id, 'body_limit' FROM checked WHERE length(body) > lim UNION ALL SELECT id, 'empty' FROM checked WHERE trim(coalesce(value, '')) = '' AND trim(coalesce(body, '')) = ''
 UNION ALL SELECT id, 'confidence_range' FROM checked WHERE confidence NOT BETWEEN 0 AND 1 UNION ALL SELECT id, 'importance_range' FROM checked WHERE importance NOT BETWEEN 0 AND 1
 UNION ALL SELECT id, 'valid_order' FROM checked WHERE valid_to < valid_from UNION ALL SELECT id, 'active_ended' FROM checked WHERE status = 'active' AND valid_to IS NOT NULL
 UNION ALL SELECT id, 'ended_open' FROM checked WHERE status IN ('superseded', 'expired') AND valid_to IS NULL UNION ALL SELECT id, 'superseded_by_missing' FROM checked WHERE status = 'superseded' AND coalesce(superseded_by, '') = ''
 UNION ALL SELECT id, 'unknown_relation' FROM checked WHERE len(links) > 0 AND split_part(links[1], ':', 1) NOT IN {RELATIONS})"""
HARD_SQL = f"(starts_with(problem, 'missing_') OR problem IN {C.HARD})"


@query(PROBLEMS_SQL + f" SELECT id, problem, {HARD_SQL} AS hard FROM problems")
def f8_problems(spark, sf_dir):
    return C.problems(claims(spark, sf_dir))


@query(PROBLEMS_SQL + ", bad AS (SELECT DISTINCT id FROM problems) SELECT count(*) FILTER (b.id IS NULL) AS ok, count(*) FILTER (b.id IS NOT NULL) AS rejected FROM claims c LEFT JOIN bad b USING (id)")
def f11_final_check(spark, sf_dir):
    return C.final_check(claims(spark, sf_dir))


@query("SELECT id, confidence FROM claims WHERE status IN ('active', 'disputed') AND (status = 'disputed' OR confidence < 0.5)")
def f12_needs_review(spark, sf_dir):
    return C.needs_review(claims(spark, sf_dir)).select("id", "confidence")


IDLE_SQL = "greatest(0.0, (epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(coalesce(last_hit, recorded_at))) / 86400.0)"
COLD_SQL = f"status = 'active' AND type NOT IN ('profile', 'preference', 'decision') AND len(links) = 0 AND coalesce(superseded_by, '') = '' AND {IDLE_SQL} > 90 AND importance <= 0.25"


@query(f"SELECT id FROM claims WHERE {COLD_SQL}")
def f13_archive_candidates(spark, sf_dir):
    return C.archive_candidates(claims(spark, sf_dir), "2024-06-01 00:00:00").select("id")


@query(f"SELECT id, {IDLE_SQL} AS idle FROM claims")
def m8_days_since_hit(spark, sf_dir):
    idle = D.days_since_hit(F.col("last_hit"), F.col("recorded_at"), F.col("valid_from"), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return claims(spark, sf_dir).select("id", idle.alias("idle"))


@query("SELECT id, status = 'active' AND valid_to IS NULL AS is_current FROM claims")
def x4_current(spark, sf_dir):
    return C.current(claims(spark, sf_dir)).select("id", "is_current")


def _loose(spark, sf_dir):
    """Cards as an extractor may give them: blanks in slots, unknown types and states, numbers out of range, long lists."""
    c = claims(spark, sf_dir)
    n = F.col("num")
    return c.select(
        "id", F.when(n % 5 == 0, "memo").otherwise(F.col("type")).alias("type"), F.when(n % 4 == 0, F.repeat(F.concat("title", F.lit(" ")), F.lit(20))).otherwise(F.col("title")).alias("title"),
        F.concat(F.lit(" My "), "subject", F.lit("\t")).alias("subject"), F.when(n % 11 == 0, "  ").otherwise(F.concat(F.lit("a  "), "predicate")).alias("predicate"), F.when(n % 3 > 0, F.col("value")).alias("value"),
        F.when(n % 2 == 0, "active").otherwise("odd").alias("status"), F.when(n % 6 == 0, "much").otherwise((n % 3 - 0.5).cast("string")).alias("confidence"), F.lit(None).cast("string").alias("importance"),
        F.when(n % 2 == 0, "2024-02-03").otherwise("soon").alias("valid_from"), F.when(n % 8 == 0, "2024-05-01").alias("valid_to"), F.repeat(F.col("body"), (n % 40).cast("int")).alias("body"),
        F.transform(F.sequence(F.lit(1), (n % 20 + 1).cast("int")), lambda i: F.concat(F.lit(" t"), i.cast("string"))).alias("tags"), F.array(F.lit("extends:a"), F.lit("likes:b"), F.lit("c"), F.lit("supports:d")).alias("links"))


NORMAL_SQL = f""", {TYPES_SQL}, loose AS (SELECT id, num, CASE WHEN num % 5 = 0 THEN 'memo' ELSE type END AS type, CASE WHEN num % 4 = 0 THEN repeat(title || ' ', 20) ELSE title END AS title, 'My-' || subject AS subject,
  CASE WHEN num % 11 = 0 THEN '' ELSE 'a_' || replace(predicate, ' ', '_') END AS predicate, CASE WHEN num % 3 > 0 THEN value END AS value, CASE WHEN num % 6 = 0 THEN 0.8 ELSE greatest(0, least(1, num % 3 - 0.5)) END::DOUBLE AS confidence,
  CASE WHEN num % 2 = 0 THEN DATE '2024-02-03' ELSE DATE '2024-03-01' END AS valid_from, CASE WHEN num % 8 = 0 THEN DATE '2024-05-01' END AS valid_to, trim(repeat(body, num % 40)) AS body FROM claims),
 normal AS (SELECT id, num, type, trim(substr(trim(title), 1, 120)) AS t0, substr(trim(title), 1, 120) AS title, subject, predicate, substr(trim(coalesce(value, title)), 1, 300) AS value, confidence, type_importance AS importance, valid_from, valid_to,
  CASE WHEN length(body) > body_limit THEN substr(body, 1, body_limit - 20) || chr(10) || '[内容超长已截断]' ELSE body END AS body, least(12, num % 20 + 1) AS tags FROM loose JOIN types USING (type) WHERE predicate <> '')"""


@query(NORMAL_SQL + " SELECT id, type, title, subject, predicate, value, 'active' AS status, confidence, importance, valid_from, valid_to, sha1(body) AS body, tags::INTEGER AS tags, 'extends:a,supports:d' AS links, lower(trim(subject)) || '::' || lower(trim(predicate)) AS slot FROM normal")
def f14_normalised(spark, sf_dir):
    n = I.normalised(_loose(spark, sf_dir), "2024-03-01")
    return n.select("id", "type", "title", "subject", "predicate", "value", "status", "confidence", "importance", "valid_from", "valid_to", F.sha1(F.col("body").cast("binary")).alias("body"), F.size("tags").alias("tags"), F.array_join("links", ",").alias("links"), "slot")


IMPORT_SQL = f""", {TYPES_SQL}, odd AS (SELECT c.* REPLACE (CASE WHEN num % 7 = 0 THEN '' ELSE title END AS title, CASE WHEN num % 5 = 0 THEN 'a' || chr(9) || 'b' ELSE subject END AS subject, CASE WHEN num % 3 = 0 THEN -0.5 ELSE confidence END AS confidence, repeat(body, (num % 60)) AS body, CASE WHEN num % 4 = 0 THEN ' ' ELSE value END AS value),
  t.type AS known, coalesce(t.body_limit, 1200) AS lim FROM claims c LEFT JOIN types t USING (type)),
 rejected AS (SELECT id, 'missing_title' AS problem FROM odd WHERE title = '' UNION ALL SELECT id, 'unknown_type' FROM odd WHERE known IS NULL UNION ALL SELECT id, 'subject_space' FROM odd WHERE regexp_matches(subject, '\\s')
  UNION ALL SELECT id, 'predicate_space' FROM odd WHERE regexp_matches(predicate, '\\s') UNION ALL SELECT id, 'body_limit' FROM odd WHERE length(body) > lim UNION ALL SELECT id, 'empty' FROM odd WHERE trim(value) = '' AND trim(body) = ''
  UNION ALL SELECT id, 'confidence_range' FROM odd WHERE confidence NOT BETWEEN 0 AND 1 UNION ALL SELECT id, 'valid_order' FROM odd WHERE valid_to < valid_from UNION ALL SELECT id, 'active_ended' FROM odd WHERE status = 'active' AND valid_to IS NOT NULL)"""


def _odd(spark, sf_dir):
    n = F.col("num")
    return claims(spark, sf_dir).withColumns({
        "title": F.when(n % 7 == 0, "").otherwise(F.col("title")), "subject": F.when(n % 5 == 0, "a\tb").otherwise(F.col("subject")), "confidence": F.when(n % 3 == 0, -0.5).otherwise(F.col("confidence")),
        "body": F.repeat(F.col("body"), (n % 60).cast("int")), "value": F.when(n % 4 == 0, " ").otherwise(F.col("value"))})


@query(IMPORT_SQL + " SELECT id, problem FROM rejected")
def f9_import_problems(spark, sf_dir):
    return I.problems(_odd(spark, sf_dir))


@query(IMPORT_SQL + " SELECT id, id NOT IN (SELECT id FROM rejected) AS plain FROM odd WHERE id NOT IN (SELECT id FROM rejected WHERE problem <> 'body_limit')")
def x9_forced(spark, sf_dir):
    odd = _odd(spark, sf_dir)
    plain = I.accepted(odd).select(F.col("id").alias("_id"))
    return I.accepted(odd, force=True).join(plain, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("plain"))


# --- joins -----------------------------------------------------------------------------------

@query(f", {TYPES_SQL} SELECT id, type, coalesce(ttl_days, 365) AS ttl_days, coalesce(body_limit, 1200) AS body_limit FROM claims LEFT JOIN types USING (type)")
def ja_types(spark, sf_dir):
    return C.with_type(claims(spark, sf_dir)).select("id", "type", "ttl_days", "body_limit")


BASELINE_SQL = VALUES_SQL + f""", inc AS (SELECT * FROM grams WHERE num % 2 = 0), base AS (SELECT * FROM grams WHERE num % 2 = 1 AND status = 'active'),
 sims AS (SELECT inc.slot, inc.id AS new_id, base.id AS old_id, base.num AS old_num, {sim_sql('inc', 'base')} AS similarity FROM inc JOIN base ON inc.slot = base.slot),
 best AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, old_num) AS r FROM sims)"""


def _halves(spark, sf_dir):
    c = claims(spark, sf_dir)
    return c.where("num % 2 = 0"), C.active(c.where("num % 2 = 1"))


@query(BASELINE_SQL.replace(", base AS (SELECT * FROM grams", ", old AS (SELECT * FROM grams").replace("base.", "old.").replace("JOIN base", "JOIN old").replace("'base'", "'old'").replace("FROM grams WHERE num % 2 = 0", "FROM (SELECT * REPLACE (CASE WHEN num % 13 = 0 THEN '' ELSE v END AS v, CASE WHEN num % 13 = 0 THEN [] ELSE g END AS g) FROM grams) WHERE num % 2 = 0") + " SELECT slot, new_id, CASE WHEN similarity > 0 THEN old_id END AS old_id, similarity, CASE WHEN similarity >= 0.93 THEN 'identical' WHEN similarity >= 0.7 THEN 'enrichment' ELSE 'contradiction' END AS kind FROM best WHERE r = 1")
def jb_baseline(spark, sf_dir):
    """Every thirteenth card says nothing and is like none."""
    new, old = _halves(spark, sf_dir)
    return C.against_baseline(new.withColumn("value", F.when(F.col("num") % 13 == 0, "!").otherwise(F.col("value"))), old)


@query("SELECT DISTINCT slot FROM claims WHERE num % 2 = 0 AND slot NOT IN (SELECT slot FROM claims WHERE num % 2 = 1 AND status = 'active')")
def jc_new_slots(spark, sf_dir):
    return C.new_slots(*_halves(spark, sf_dir))


@query("SELECT slot, count(*) AS n FROM claims WHERE num % 2 = 1 AND status = 'active' AND slot NOT IN (SELECT slot FROM claims WHERE num % 2 = 0) GROUP BY slot")
def jd_uncovered(spark, sf_dir):
    return C.uncovered(*_halves(spark, sf_dir))


@query(VALUES_SQL + f" SELECT a.slot, max({sim_sql('a', 'b')}) AS sim FROM grams a JOIN grams b ON a.slot = b.slot AND a.num < b.num GROUP BY a.slot")
def je_slot_similarity(spark, sf_dir):
    return C.slot_similarity(claims(spark, sf_dir))


@query(VALUES_SQL + f", p AS (SELECT a.id AS a, b.id AS b, {sim_sql('a', 'b')} AS sim FROM grams a JOIN grams b ON a.slot = b.slot AND a.num < b.num) SELECT * FROM p WHERE sim >= 0.88")
def jf_near_pairs(spark, sf_dir):
    return C.near_pairs(claims(spark, sf_dir))


@query(", ends AS (SELECT id, CASE WHEN num % 9 = 1 THEN split_part(links[1], ':', 2) ELSE split_part(links[1], ':', 1) END AS target FROM claims WHERE status = 'active' AND len(links) > 0) SELECT id, target FROM ends WHERE target NOT IN (SELECT id FROM claims)")
def jg_orphan_links(spark, sf_dir):
    return U.orphan_links(claims(spark, sf_dir))


@query(", refs AS (SELECT 'map' || CAST(num % 50 AS VARCHAR) AS map, id FROM claims) SELECT map, string_agg(id, ',' ORDER BY id) AS stale, count(*) AS n FROM refs WHERE id NOT IN (SELECT id FROM claims WHERE status = 'active') GROUP BY map")
def jh_stale_maps(spark, sf_dir):
    c = claims(spark, sf_dir)
    refs = c.select(F.concat(F.lit("map"), (F.col("num") % 50).cast("string")).alias("map"), "id")
    gone = refs.join(C.active(c).select("id"), "id", "left_anti")
    return gone.groupBy("map").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("stale"), F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS chunk, CASE WHEN n = 0 THEN 'missing' WHEN ok = 0 THEN 'error' ELSE 'ok' END AS state, ok AS cards FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'N') AS ok FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 25) ON o_orderkey = l_orderkey GROUP BY 1)", None)
def ji_progress(spark, sf_dir):
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    results = li.where("l_quantity > 25").select(F.col("l_orderkey").cast("string").alias("chunk"), F.when(F.col("l_returnflag") != "N", "no_cards").alias("error"))
    return A.progress(o.select(F.col("o_orderkey").cast("string").alias("chunk")), results)


@query(", c AS (SELECT slot, count(*) AS n FROM claims WHERE status = 'active' GROUP BY slot HAVING count(*) > 1), d AS (SELECT slot, CASE WHEN n > 2 THEN 'keep_latest' ELSE 'keep_first' END AS decision FROM c), r AS (SELECT c.id, c.slot, d.decision, row_number() OVER (PARTITION BY c.slot ORDER BY CASE WHEN d.decision = 'keep_first' THEN num ELSE -num END) AS r FROM claims c JOIN d USING (slot) WHERE status = 'active') SELECT id, slot, decision, r = 1 AS kept FROM r")
def jk_decisions(spark, sf_dir):
    c = C.active(claims(spark, sf_dir))
    d = c.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot", F.when(F.col("n") > 2, "keep_latest").otherwise("keep_first").alias("decision"))
    order = F.when(F.col("decision") == "keep_first", F.col("num")).otherwise(-F.col("num"))
    return c.join(d, "slot").select("id", "slot", "decision", (F.row_number().over(W.partitionBy("slot").orderBy(order)) == 1).alias("kept"))


@query(", used AS (SELECT num * 3 AS k FROM claims), inc AS (SELECT id, row_number() OVER (ORDER BY num) AS i FROM claims), free AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT unnest(range(1, 2 + 4 * (SELECT count(*) FROM claims))) AS k) WHERE k NOT IN (SELECT k FROM used)) SELECT id, printf('mem_%05d', k) AS new_id FROM inc JOIN free USING (i)")
def jl_free_ids(spark, sf_dir):
    c = claims(spark, sf_dir)
    used = c.select(F.format_string("mem_%05d", F.col("num") * 3).alias("id"))
    return C.assigned_ids(c.select("id", F.col("num").alias("ord")), used, 1).select("id", "new_id")


@query("SELECT id FROM claims c WHERE EXISTS (SELECT 1 FROM customer k WHERE lower(c.subject) = 'user:' || CAST(k.c_custkey AS VARCHAR) AND k.c_nationkey = 3)")
def jn_subject_semi(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey = 3").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("_s"))
    return claims(spark, sf_dir).join(k, F.lower("subject") == F.col("_s"), "left_semi").select("id")


# --- aggregates ------------------------------------------------------------------------------

@query("SELECT type, status, count(*) AS n FROM claims GROUP BY ROLLUP (type, status)")
def a1_counts(spark, sf_dir):
    return claims(spark, sf_dir).rollup("type", "status").agg(F.count("*").alias("n"))


@query("SELECT slot, count(*) AS n FROM claims WHERE status = 'active' GROUP BY slot HAVING count(*) > 1")
def a2_conflict_slots(spark, sf_dir):
    return C.active(claims(spark, sf_dir)).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")


CONFLICTS_SQL = f""", g AS (SELECT slot, count(*) AS n, count(DISTINCT digest) AS digests, count(DISTINCT source) AS sources,
 string_agg(id, ',' ORDER BY valid_from DESC, num DESC) AS members, first(id ORDER BY valid_from DESC, num DESC) AS newest, first(value ORDER BY valid_from DESC, num DESC) AS claim,
 first(id ORDER BY length(body) DESC, recorded_at DESC, num) AS keeper, first(recorded_at ORDER BY valid_from DESC, num DESC) AS newest_at, min(recorded_at) AS oldest_at
 FROM claims WHERE status = 'active' GROUP BY slot HAVING count(*) > 1)"""


@query(CONFLICTS_SQL + " SELECT slot, n, CASE WHEN digests < n THEN 'duplicate' ELSE 'divergent' END AS kind, members, newest FROM g")
def a3_conflicts(spark, sf_dir):
    return C.conflicts(claims(spark, sf_dir)).select("slot", "n", "kind", "members", "newest")


ACTIONS_SQL = CONFLICTS_SQL + f""", p AS (SELECT *, contains(claim, 'no longer') AS explicit, contains(claim, 'as of') AS restated, sources = 1 AND (epoch({REF}) - epoch(newest_at)) / 86400.0 <= 30 AND (epoch({REF}) - epoch(oldest_at)) / 86400.0 <= 180 AS near FROM g),
 act AS (SELECT *, CASE WHEN digests < n THEN 'merge' WHEN (explicit OR restated) AND near OR explicit AND restated THEN 'supersede' ELSE 'escalate' END AS action,
  CASE WHEN digests < n THEN 0.95 WHEN (explicit OR restated) AND near THEN 0.75 WHEN explicit AND restated THEN 0.6 ELSE 0.0 END AS action_confidence FROM p)"""


@query(ACTIONS_SQL + " SELECT slot, action, action_confidence FROM act")
def a4_proposals(spark, sf_dir):
    return C.proposals(claims(spark, sf_dir), REF_TS).select("slot", "action", "action_confidence")


@query(CONFLICTS_SQL + " SELECT slot, keeper FROM g")
def a5_keepers(spark, sf_dir):
    return C.conflicts(claims(spark, sf_dir)).select("slot", "keeper")


TRUTH_SQL = """, dated AS (SELECT *, coalesce(CASE WHEN num % 2 = 1 THEN CAST(valid_from AS TIMESTAMP) END, recorded_at) AS since FROM claims WHERE status IN ('active', 'disputed') AND num % 11 <> 0),
 truth AS (SELECT slot, first(id ORDER BY since DESC, num DESC) AS current, string_agg(id, ',' ORDER BY since DESC, num DESC) AS members, bool_or(status = 'disputed') AS needs_human FROM dated GROUP BY slot HAVING count(*) >= 2)"""


def _undated(cards):
    """Every other card without the day from which it is valid, every eleventh without a subject."""
    return cards.withColumn("valid_from", F.when(F.col("num") % 2 == 1, F.col("valid_from"))).withColumn("subject", F.when(F.col("num") % 11 != 0, F.col("subject")))


@query(TRUTH_SQL + " SELECT * FROM truth")
def a6_truth_table(spark, sf_dir):
    return C.truth_table(_undated(claims(spark, sf_dir)))


@query(VALUES_SQL + f", s AS (SELECT a.slot, max({sim_sql('a', 'b')}) AS similarity FROM grams a JOIN grams b ON a.slot = b.slot AND a.num < b.num GROUP BY a.slot), g AS (SELECT slot, count(*) AS n, count(DISTINCT v) AS k, bool_or(contains(value, 'no longer')) AS changed FROM grams GROUP BY slot HAVING count(*) > 1) SELECT slot, n, CASE WHEN k = 1 THEN 'duplicate' ELSE 'divergent' END AS kind, similarity, CASE WHEN similarity >= 0.88 THEN 'merge' WHEN changed THEN 'supersede' WHEN similarity >= 0.7 THEN 'merge' ELSE 'escalate' END AS action FROM g JOIN s USING (slot)")
def a7_internal_conflicts(spark, sf_dir):
    return C.internal_conflicts(claims(spark, sf_dir))


SIM_IN_FOLD = sim_sql("p", "r")
DEDUPE_SQL = VALUES_SQL.replace(" AS (", " AS MATERIALIZED (", 1) + f""", firsts AS (SELECT id, slot, num, digest, v, g, first_value(id) OVER (PARTITION BY digest ORDER BY num) AS lead, row_number() OVER (PARTITION BY digest ORDER BY num) AS k FROM grams),
 u AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY num) AS i FROM firsts WHERE k = 1),
 fold AS (SELECT slot, i, id, NULL::VARCHAR AS into_, [{{'id': id, 'v': v, 'g': g}}] AS kept FROM u WHERE i = 1
  UNION ALL SELECT slot, i, id, hit, CASE WHEN hit IS NULL THEN list_append(kept, {{'id': id, 'v': v, 'g': g}}) ELSE kept END FROM (SELECT r.*, f.kept, list_filter(f.kept, lambda p: {SIM_IN_FOLD} >= 0.88)[1].id AS hit FROM fold f JOIN u r ON r.slot = f.slot AND r.i = f.i + 1)),
 said AS (SELECT id, slot, CASE WHEN into_ IS NOT NULL THEN 'near' END AS reason, into_ FROM fold)"""


@query(DEDUPE_SQL + " SELECT id, slot, reason, into_ AS into FROM said UNION ALL SELECT f.id, f.slot, CASE WHEN s.into_ IS NULL THEN 'exact' ELSE 'near' END, coalesce(s.into_, f.lead) FROM firsts f JOIN said s ON f.lead = s.id WHERE f.k > 1", CLAIMS_SQL.replace("WITH ", "WITH RECURSIVE ", 1))
def a8_dedupe(spark, sf_dir):
    return C.deduplicated(claims(spark, sf_dir))


@query(" SELECT count(*) AS n, sum(length(body)) AS total, list_sort(list(length(body)))[(count(*) // 2 + 1)::BIGINT] AS median, list_sort(list(length(body)))[(floor(count(*) * 0.95) + 1)::BIGINT] AS p95, max(length(body)) AS longest FROM claims")
def a10_order_statistics(spark, sf_dir):
    return U.order_statistics(claims(spark, sf_dir))


@query(" SELECT type, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + ", count(*) AS total FROM claims GROUP BY type")
def a11_overview(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("type").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


@query(" SELECT split_part(predicate, '_', 1) AS head, count(*) AS n, count(DISTINCT slot) AS slots FROM claims WHERE status = 'active' GROUP BY 1")
def a14_heads(spark, sf_dir):
    return U.heads(claims(spark, sf_dir))


@query(", u AS (SELECT slot, unnest(tags) AS t FROM claims WHERE num <= 2000), tg AS (SELECT slot, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM u GROUP BY slot), b AS (SELECT slot, count(*) AS n, sum(hits)::BIGINT AS hits, string_agg(body, chr(10) || chr(10) ORDER BY num) AS body FROM claims WHERE num <= 2000 GROUP BY slot) SELECT slot, n, hits, tags, body FROM b JOIN tg USING (slot)".replace(" WHERE num <= 2000", ""))
def a15_merged(spark, sf_dir):
    return C.merged(claims(spark, sf_dir))


@query(" SELECT slot, first(title ORDER BY num) AS title, count(*) AS n FROM claims WHERE status = 'active' GROUP BY slot")
def a16_slots(spark, sf_dir):
    return U.slots(claims(spark, sf_dir))


@query(" SELECT slot, first(title ORDER BY num) AS title, count(*) AS n FROM claims WHERE status = 'active' GROUP BY slot ORDER BY slot LIMIT 60")
def o7_first_slots(spark, sf_dir):
    return U.slots(claims(spark, sf_dir), 60)


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY importance DESC, hits DESC, num) AS r, count(*) OVER (PARTITION BY subject) AS cards FROM claims WHERE status = 'active') SELECT subject, cards, id, r FROM r WHERE r <= 5")
def a18_brief(spark, sf_dir):
    w = W.partitionBy("subject")
    c = C.active(claims(spark, sf_dir)).withColumn("r", F.row_number().over(w.orderBy(F.desc("importance"), F.desc("hits"), "num"))).withColumn("cards", F.count("*").over(w))
    return c.where("r <= 5").select("subject", "cards", "id", "r")


@query(" SELECT count(*) AS cards, count(*) FILTER (status = 'active') AS active, count(DISTINCT slot) AS slots FROM claims")
def a19_library(spark, sf_dir):
    return claims(spark, sf_dir).agg(F.count("*").alias("cards"), F.count_if(F.col("status") == "active").alias("active"), F.count_distinct("slot").alias("slots"))


# --- windows, order, sets --------------------------------------------------------------------

@query(" SELECT id, slot, row_number() OVER (PARTITION BY slot ORDER BY valid_from DESC, num DESC) AS rank FROM claims")
def w1_newest(spark, sf_dir):
    return C.newest_first(claims(spark, sf_dir)).select("id", "slot", "rank")


@query(" SELECT id, hits FROM claims WHERE hits > 0 ORDER BY hits DESC, num LIMIT 10")
def o2_hot(spark, sf_dir):
    return claims(spark, sf_dir).where("hits > 0").orderBy(F.desc("hits"), "num").limit(10).select("id", "hits")


@query(" SELECT id, importance FROM claims WHERE status = 'active' ORDER BY importance DESC, hits DESC, num LIMIT 60")
def o3_important(spark, sf_dir):
    return C.active(claims(spark, sf_dir)).orderBy(F.desc("importance"), F.desc("hits"), "num").limit(60).select("id", "importance")


@query(" SELECT id FROM claims WHERE status = 'active' UNION ALL SELECT id FROM claims WHERE status = 'expired'")
def u1_union(spark, sf_dir):
    c = claims(spark, sf_dir)
    return C.active(c).select("id").unionByName(c.where("status = 'expired'").select("id"))


@query(" SELECT id, list_aggregate(list_sort(list_intersect(tags, ['click', 'k1', 'k2'])), 'string_agg', ',') AS shared FROM claims WHERE list_has_any(tags, ['click', 'k1', 'k2'])")
def u3_shared_tags(spark, sf_dir):
    both = F.array_intersect("tags", F.array(F.lit("click"), F.lit("k1"), F.lit("k2")))
    return claims(spark, sf_dir).select("id", F.array_join(F.array_sort(both), ",").alias("shared")).where("shared <> ''")


@query(" SELECT DISTINCT type FROM claims EXCEPT SELECT DISTINCT type FROM claims WHERE num % 10 = 0 AND status = 'active'")
def u6_uncovered_types(spark, sf_dir):
    c = claims(spark, sf_dir)
    return c.select("type").subtract(c.where("num % 10 = 0 and status = 'active'").select("type"))


# --- scalar functions ------------------------------------------------------------------------

@query(r" SELECT id, slot, digest, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(title || ' ' || value, '[A-Za-z0-9_]+'), lambda w: lower(w)))), 'string_agg', ' ') AS tokens FROM claims")
def t1_tokens(spark, sf_dir):
    return claims(spark, sf_dir).select("id", "slot", "digest", F.array_join(F.array_sort(T.tokens(F.concat_ws(" ", "title", "value"))), " ").alias("tokens"))


@query(f" SELECT id, {AGE_SQL} AS age, power(0.5, {AGE_SQL} / 180.0) AS recency, least(1.0, ln(1.0 + hits) / ln(21.0::DOUBLE)) AS reuse FROM claims")
def m5_decay(spark, sf_dir):
    age = D.age_days(F.col("recorded_at"), F.col("valid_from"), F.lit(REF_TS).cast("timestamp"))
    return claims(spark, sf_dir).select("id", age.alias("age"), D.recency(age, 180.0).alias("recency"), D.reuse(F.col("hits")).alias("reuse"))


def _search_sql() -> str:
    words = sorted(set(re.findall("[a-z0-9_]+", QUERY.lower())))
    q, flat, compact = "[" + ", ".join(f"'{w}'" for w in words) + "]", QUERY.lower(), QUERY.lower().replace("_", "").replace("-", "").replace(":", "")
    hay = r"list_distinct(list_transform(regexp_extract_all(concat_ws(' ', title, value, body, array_to_string(tags, ' '), predicate), '[A-Za-z0-9_]+'), lambda w: lower(w)))"
    pred = "replace(lower(predicate), '_', '')"
    n = f"len(list_intersect({q}, list_distinct(regexp_extract_all(lower(array_to_string(aliases, ' ')), '[a-z0-9_]+'))))"
    alias = f"CASE WHEN {n} > 0 THEN least(1.0, {n} / {float(min(len(words), 6))}) ELSE 0.0 END::DOUBLE"
    pen = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTIES.items()) + " END"
    w = WEIGHTS
    return f""", s AS (SELECT id, num, len(list_intersect({q}, {hay}))::DOUBLE / {len(words)} AS lexical,
 {alias} AS alias_hit, (CASE WHEN contains('{compact}', lower(split_part(subject, ':', -1))) THEN 0.6 ELSE 0.0 END) + (CASE WHEN length({pred}) > 2 AND contains('{compact}', {pred}) THEN 0.6 ELSE 0.0 END) AS slot_exact,
 CASE WHEN len(list_filter(tags, lambda t: list_contains({q}, lower(t)) OR contains('{flat}', lower(t)))) > 0 THEN 1.0 ELSE 0.0 END AS tag_hit, importance, confidence,
 power(0.5, {AGE_SQL} / 180.0) AS recency, least(1.0, ln(1.0 + hits) / ln(21.0::DOUBLE)) AS reuse, {pen} AS penalty FROM claims WHERE status = 'active'),
 r AS (SELECT *, lexical * {w['lexical']}::DOUBLE + slot_exact * {w['slot_exact']}::DOUBLE + tag_hit * {w['tag_hit']}::DOUBLE + alias_hit * {w['alias_hit']}::DOUBLE AS relevance, importance * {w['importance']}::DOUBLE + confidence * {w['confidence']}::DOUBLE + recency * {w['recency']}::DOUBLE + reuse * {w['reuse']}::DOUBLE AS prior FROM s),
 z AS (SELECT *, relevance * (1 + prior) + penalty AS score FROM r) SELECT id, round(score, 9) AS score, lexical, slot_exact::DOUBLE AS slot_exact, tag_hit::DOUBLE AS tag_hit, alias_hit FROM z WHERE relevance > 0 AND score > 0 ORDER BY z.score DESC, num LIMIT 8"""


@query(_search_sql())
def m7_search(spark, sf_dir):
    return C.search(claims(spark, sf_dir), QUERY, REF_TS).select("id", F.round("score", 9).alias("score"), "lexical", "slot_exact", "tag_hit", "alias_hit")


#: A query for each supplier, of four kinds.
ASKED_SQL = """, asked AS (SELECT s_suppkey AS qid, CASE s_suppkey % 4 WHEN 0 THEN 'click by ' || s_suppkey || ' on k1 card' WHEN 1 THEN 'What of User:' || s_suppkey || ', reply-style of team all?' WHEN 2 THEN 'reply_style in team:all, no longer k=' || s_suppkey ELSE 'ERROR card number ' || s_suppkey END AS q FROM supplier)"""


def _asked(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    j = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    n = F.col("s_suppkey") % 4
    q = F.when(n == 0, j("click by ", k, " on k1 card")).when(n == 1, j("What of User:", k, ", reply-style of team all?")).when(n == 2, j("reply_style in team:all, no longer k=", k)).otherwise(j("ERROR card number ", k))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("qid"), q.alias("query"))


def _search_many_sql() -> str:
    words = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda w: lower(w)))"
    pen = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTIES.items()) + " END"
    w = WEIGHTS
    return ASKED_SQL + f""", a AS MATERIALIZED (SELECT qid, lower(q) AS flat, regexp_replace(lower(q), '[_:-]', '', 'g') AS compact, {words.format('q')} AS ts FROM asked),
 h AS MATERIALIZED (SELECT *, {words.format("concat_ws(' ', title, value, body, array_to_string(tags, ' '), predicate)")} AS hay, {words.format("array_to_string(aliases, ' ')")} AS ats, lower(array_to_string(aliases, ' ')) AS names, split_part(split_part(slot, '::', 1), ':', -1) AS last, replace(split_part(slot, '::', 2), '_', '') AS pred,
  importance * {w['importance']}::DOUBLE + confidence * {w['confidence']}::DOUBLE + power(0.5, {AGE_SQL} / 180.0) * {w['recency']}::DOUBLE + least(1.0, ln(1.0 + hits) / ln(21.0::DOUBLE)) * {w['reuse']}::DOUBLE AS prior, {pen} AS penalty FROM claims WHERE status = 'active'),
 s AS (SELECT qid, id, num, prior, penalty, len(list_intersect(ts, hay))::DOUBLE / len(ts) AS lexical, (CASE WHEN last <> '' AND contains(compact, last) THEN 0.6 ELSE 0.0 END + CASE WHEN length(split_part(slot, '::', 2)) > 2 AND contains(compact, pred) THEN 0.6 ELSE 0.0 END)::DOUBLE AS slot_exact,
  CASE WHEN len(list_filter(tags, lambda t: contains(flat, lower(t)))) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS tag_hit, (CASE WHEN len(list_intersect(ts, ats)) > 0 THEN least(1.0, len(list_intersect(ts, ats)) / least(len(ts), 6)::DOUBLE) WHEN names <> '' AND contains(flat, names) THEN 1.0 ELSE 0.0 END)::DOUBLE AS alias_hit FROM a, h),
 z AS (SELECT *, lexical * {w['lexical']}::DOUBLE + slot_exact * {w['slot_exact']}::DOUBLE + tag_hit * {w['tag_hit']}::DOUBLE + alias_hit * {w['alias_hit']}::DOUBLE AS relevance FROM s), y AS (SELECT *, relevance * (1 + prior) + penalty AS score FROM z),
 best AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, num))::INTEGER AS rank, id, round(score, 9) AS score, lexical, slot_exact, tag_hit, alias_hit FROM y WHERE relevance > 0 AND score > 0 QUALIFY rank <= 8)"""


@query(_search_many_sql() + " SELECT * FROM best")
def m7_many_queries(spark, sf_dir):
    """A query for each supplier, all at once, over an inverted index."""
    found = Q.search_many(claims(spark, sf_dir), _asked(spark, sf_dir), REF_TS)
    return found.withColumn("score", F.round("score", 9))


NAMED_SQL = ASKED_SQL + r""", named AS (SELECT qid, unnest(list_distinct(list_transform(regexp_extract_all(q, '[\w-]+:[\w-]+'), lambda x: lower(x)))) AS subject FROM asked)"""


@query(NAMED_SQL + " SELECT qid, id FROM named JOIN claims ON lower(claims.subject) = named.subject")
def m7_same_slot(spark, sf_dir):
    return Q.same_slot(claims(spark, sf_dir), _asked(spark, sf_dir))


@query(_search_many_sql() + NAMED_SQL.replace(ASKED_SQL, "") + """, x AS (SELECT qid, id FROM named JOIN claims ON lower(claims.subject) = named.subject), every AS (SELECT * FROM x UNION ALL SELECT qid, id FROM best WHERE qid NOT IN (SELECT qid FROM x))
 SELECT qid, slot, first(id ORDER BY valid_from DESC, num DESC) AS current, string_agg(id, ',' ORDER BY valid_from DESC, num DESC) AS members, bool_or(status = 'disputed') AS needs_human FROM every JOIN claims USING (id) WHERE status IN ('active', 'disputed') GROUP BY qid, slot HAVING count(*) >= 2""")
def m7_contested(spark, sf_dir):
    """What stands against each other in what the queries name, else in what they find."""
    c, asked = claims(spark, sf_dir), _asked(spark, sf_dir)
    return Q.contested(c, asked, Q.search_many(c, asked, REF_TS))


@query(f", {TYPES_SQL} SELECT id, floor(coalesce(ttl_days, 365) * (0.7 + 0.6 * importance))::BIGINT AS ttl FROM claims LEFT JOIN types USING (type)")
def m9_ttl(spark, sf_dir):
    return C.with_type(claims(spark, sf_dir)).select("id", D.effective_ttl(F.col("ttl_days"), F.col("importance")).alias("ttl"))


@query(" SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events", None)
def n1_json_path(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.alias("k"), k.try_cast("int").alias("n"))


# --- sampling --------------------------------------------------------------------------------

@query(" SELECT id FROM claims ORDER BY sha1('7|' || id), id LIMIT 200")
def p2_sample(spark, sf_dir):
    return C.sampled(claims(spark, sf_dir), 200, 7).select("id")


@query(", t AS (SELECT * REPLACE (CASE WHEN num % 6 > 0 THEN type END AS type) FROM claims), c AS (SELECT type, count(*) AS c FROM t GROUP BY type), x AS (SELECT type, c, 100 * c / sum(c) OVER () AS x FROM c), b AS (SELECT *, floor(x) AS base FROM x), q AS (SELECT type, least(base + CASE WHEN row_number() OVER (ORDER BY x - base DESC, type) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END, c) AS quota FROM b), r AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY sha1('7|' || id), id) AS r FROM t) SELECT id, r.type FROM r JOIN q ON r.type IS NOT DISTINCT FROM q.type WHERE r <= quota")
def p3_stratified(spark, sf_dir):
    """Every sixth card has no type: those are a stratum too."""
    c = claims(spark, sf_dir)
    return C.stratified(c.withColumn("type", F.when(F.col("num") % 6 > 0, F.col("type"))), 100, 7).select("id", "type")


@query(", r AS (SELECT id, slot, row_number() OVER (PARTITION BY slot ORDER BY status <> 'active', sha1('7|' || id), id) AS r FROM claims) SELECT id, slot FROM r ORDER BY r > 1, sha1('7|' || id), id LIMIT 150")
def p4_spread(spark, sf_dir):
    return C.spread(claims(spark, sf_dir), 150, 7).select("id", "slot")


# --- lifecycle -------------------------------------------------------------------------------

EXPIRY_REF = "2024-06-01 00:00:00"


@query(f", {TYPES_SQL}, x AS (SELECT c.*, status = 'active' AND greatest(0.0, (epoch(TIMESTAMP '{EXPIRY_REF}') - epoch(recorded_at)) / 86400.0) > floor(coalesce(ttl_days, 365) * (0.7 + 0.6 * importance)) AS gone FROM claims c LEFT JOIN types USING (type)) SELECT id, CASE WHEN gone THEN 'expired' ELSE status END AS status, CASE WHEN gone THEN coalesce(valid_to, DATE '2024-06-01') ELSE valid_to END AS valid_to, CASE WHEN gone THEN '{EXPIRY_REF}' END AS ended_at FROM x")
def l4_expiry(spark, sf_dir):
    c = claims(spark, sf_dir).withColumn("ended_at", F.lit(None).cast("timestamp"))
    return C.with_expiry(c, EXPIRY_REF).select("id", "status", "valid_to", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"))


# --- records and chunks ----------------------------------------------------------------------

def _texts(spark, sf_dir, table="documents", key="doc_id"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("source"), "text")


SPACES_SQL = " || ".join(f"chr({ord(c)})" for c in T.SPACES)
TRIM_SQL = f"trim({{}}, {SPACES_SQL})"
LINES_SQL = "WITH l AS (SELECT doc_id AS source, unnest(regexp_split_to_array(text, '\r?\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS pos FROM documents), k AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY pos) - 1)::INTEGER AS seq, " + TRIM_SQL.format("t") + " AS text FROM l WHERE " + TRIM_SQL.format("t") + " <> '')"


@query(" SELECT source, seq, 'line' AS kind, text, length(text)::INTEGER AS chars FROM k", LINES_SQL)
def r8_lines(spark, sf_dir):
    return R.by_lines(_texts(spark, sf_dir))


@query(" SELECT source, count(*) AS records, sum(length(text))::BIGINT AS chars, floor(avg(length(text)) + 0.5)::BIGINT AS avg_chars FROM k GROUP BY source", LINES_SQL)
def a17_file_stats(spark, sf_dir):
    return R.file_stats(R.by_lines(_texts(spark, sf_dir)))


def _said(spark, sf_dir):
    """(source, text): conversations as texts of turns under all kinds of markers, below a line that no one says."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = F.col("turn") % 2 == 1
    mark = F.when(F.col("role") == "user", F.when(odd, "User:").otherwise("Human:")).when(F.col("role") == "assistant", F.when(odd, "  assistant: ").otherwise("AI: ")).otherwise("用户:：")
    t = F.concat(mark, F.regexp_replace("text", r"\s+", "\n"))
    g = c.groupBy(F.col("conv_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))).alias("r"))
    return g.select("source", F.concat(F.lit("a talk\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("text"))


@query(r""" WITH m AS (SELECT *, CASE role WHEN 'user' THEN CASE WHEN turn % 2 = 1 THEN 'User:' ELSE 'Human:' END WHEN 'assistant' THEN CASE WHEN turn % 2 = 1 THEN 'assistant:' ELSE 'AI:' END ELSE '用户:' END AS mark FROM conversations)
 SELECT conv_id AS source, 0 AS seq, '(未标注)' AS section, '(未标注):' || chr(10) || 'a talk' AS text FROM conversations GROUP BY 1 UNION ALL
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER, mark, mark || ':' || chr(10) || regexp_replace(trim(text), '\s+', chr(10), 'g') FROM m""", None)
def r11_turns(spark, sf_dir):
    return R.turns(_said(spark, sf_dir)).select("source", "seq", "section", "text")


#: Lines of documents, windows of long ones, and their chunks by a fold in recursion.
CHUNKS_SQL = LINES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT source, seq, unnest(range(0, n)) AS part, n > 1 AS alone, text, n FROM (SELECT *, CASE WHEN chars > 800 THEN ceil(chars / 680.0)::INTEGER ELSE 1 END AS n FROM (SELECT *, length(text) AS chars FROM k))),
 v AS MATERIALIZED (SELECT source, seq, part, alone, CASE WHEN alone THEN substr(text, part * 680 + 1, 680) ELSE text END AS text, row_number() OVER (PARTITION BY source ORDER BY seq, part) AS i FROM w),
 fold AS (SELECT source, i, alone AS shut, length(text) + 2 AS used, 1 AS n, 0 AS chunk FROM v WHERE i = 1 UNION ALL
  SELECT source, i, alone, CASE WHEN fresh THEN cost ELSE used + cost END, CASE WHEN fresh THEN 1 ELSE n + 1 END, chunk + fresh::INTEGER FROM (SELECT v.source, v.i, v.alone, length(v.text) + 2 AS cost, f.used, f.n, f.chunk, f.used + length(v.text) + 2 > 800 OR f.n >= 40 OR v.alone OR f.shut AS fresh FROM fold f JOIN v ON v.source = f.source AND v.i = f.i + 1))"""


@query(""" SELECT source, chunk, count(*) AS record_count, sum(length(text) + CASE WHEN alone THEN 0 ELSE 2 END)::BIGINT AS chars,
 sha1(string_agg('<record id="' || CAST(seq AS VARCHAR) || '" loc="">' || chr(10) || text || chr(10) || '</record>', chr(10) || chr(10) ORDER BY i)) AS sha FROM v JOIN fold USING (source, i) GROUP BY 1, 2""", CHUNKS_SQL)
def k1_chunks(spark, sf_dir):
    c = R.chunks(R.by_lines(_texts(spark, sf_dir)), 800)
    return c.select("source", "chunk", "record_count", "chars", F.sha1(F.col("text").cast("binary")).alias("sha"))


@query(" SELECT doc_id AS source, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS blank_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest_line FROM documents", None)
def s8_profile(spark, sf_dir):
    return S.profile(_texts(spark, sf_dir)).select("source", "chars", "lines", "blank_lines", "longest_line")


#: Texts of every format, made of events.
FORMATS = ("log", "jsonl", "yaml", "csv", "json", "text")


def _formatted(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id").cast("string")
    row = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    three = lambda x, between="\n": F.concat_ws(between, x, x, x)
    texts = {
        "log": three(row("2024-01-05 10:00:00 ", n)), "jsonl": three(row('{"a": ', n, "}")), "yaml": three(row("k", n, ":\n  v: 1")), "csv": three(row(n, ",b,c")),
        "json": row('{"a": [', n, "]}"), "text": three(row("words and ", n))}
    pick = F.col("event_id") % len(FORMATS)
    text = F.lit(None)
    for i, f in enumerate(FORMATS):
        text = F.when(pick == i, texts[f]).otherwise(text)
    return e.select(F.col("event_id").alias("source"), text.alias("text"))


@query("SELECT event_id AS source, ['log', 'jsonl', 'yaml', 'csv', 'json', 'text'][event_id % 6 + 1] AS format, CASE WHEN event_id % 2 = 0 THEN 'markdown' ELSE ['log', 'jsonl', 'yaml', 'csv', 'json', 'text'][event_id % 6 + 1] END AS named FROM events", None)
def s7_sniffed(spark, sf_dir):
    name = F.when(F.col("source") % 2 == 0, "x.MD").otherwise("x.txt")
    return _formatted(spark, sf_dir).select("source", S.sniffed(F.col("text"), F.lit("x.txt")).alias("format"), S.sniffed(F.col("text"), name).alias("named"))


SHOWN_SQL = "'---' || chr(10) || concat_ws(chr(10), " + ", ".join(f"'{k}: ' || {v}" for k, v in {
    **{k: k for k in ("id", "type", "title", "subject", "predicate", "value", "status")}, **{k: f"CAST({k} AS VARCHAR)" for k in ("confidence", "importance", "valid_from", "valid_to")},
    "recorded_at": "strftime(recorded_at, '%Y-%m-%dT%H:%M:%S')", "source": "source", **{k: f"'[' || array_to_string({k}, ', ') || ']'" for k in ("links", "tags", "aliases")},
    "hits": "CAST(hits AS VARCHAR)", "last_hit": "strftime(last_hit, '%Y-%m-%dT%H:%M:%S')", "superseded_by": "coalesce(superseded_by, '\"\"')", "schema": f"'{S.SCHEMA}'"}.items()) + ") || chr(10) || '---' || chr(10) || body"


@query(f" SELECT type || '/' || id || '.md' AS path, {SHOWN_SQL} AS text FROM claims")
def t9_rendered(spark, sf_dir):
    return S.rendered(claims(spark, sf_dir))


# what stands in old files: no type and no status, nulls, quotes, words for days, indented keys, lists of all kinds
OLD_SQL = f"""SELECT id, CASE num % 3 WHEN 0 THEN 'lesson' WHEN 1 THEN 'lesson' ELSE type END AS type, CASE num % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'active' ELSE status END AS status, title, CASE num % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(num AS VARCHAR) WHEN 2 THEN 'True' WHEN 3 THEN 'key: x' ELSE value END AS value,
 CASE num % 3 WHEN 0 THEN CAST({REF} AS DATE) WHEN 1 THEN CAST({REF} AS DATE) - 1 ELSE valid_from END AS valid_from, CASE num % 3 WHEN 0 THEN tags[1] || ',' || tags[2] WHEN 1 THEN tags[1] || ', ' || tags[2] ELSE tags[2] END AS tags, CASE num % 2 WHEN 0 THEN 0.8 ELSE confidence END AS confidence, body, CASE WHEN num % 50 = 0 THEN 'no_id' END AS problem FROM claims"""


@query(" SELECT * REPLACE (CASE WHEN problem IS NULL THEN id END AS id) FROM (" + OLD_SQL + ")")
def s4_old_files(spark, sf_dir):
    c = claims(spark, sf_dir)
    n = lambda k: F.col("num") % k
    j = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    one, two = F.get("tags", F.lit(0)), F.get("tags", F.lit(1))
    lines = [
        j("id: ", F.when(n(50) == 0, "null").otherwise(F.col("id"))), F.when(n(3) == 1, "type: ~").when(n(3) == 2, j("  type:  ", F.col("type"))), F.when(n(4) == 1, "status:").when(n(4) > 1, j("status: '", F.col("status"), "'")),
        j("# comment: no key\ntitle: '", F.col("title"), "'"),
        F.when(n(5) == 0, "value: None").when(n(5) == 1, j("value: 00", F.col("num").cast("string"))).when(n(5) == 2, "value: yes").when(n(5) == 3, 'value: "key: x"').otherwise(j("value: old\nvalue: ", F.col("value"))),
        F.when(n(3) == 0, "valid_from: Today").when(n(3) == 1, "valid_from: yesterday").otherwise(j("valid_from: ", F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss"))),
        F.when(n(3) == 0, j("tags:\n  - ", one, "\n  - null\n  - '", two, "'")).when(n(3) == 1, j("tags: ", one, ", ", two)).otherwise(j("tags: [~, \"", two, '"]')),
        F.when(n(2) == 0, "confidence: high").otherwise(j("confidence: '", F.col("confidence").cast("string"), "'"))]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), "body")
    back = S.parsed_cards(c.select(j("a/", F.col("id"), ".md").alias("path"), text.alias("text")), F.lit(REF_TS).cast("timestamp"))
    return back.select("id", "type", "status", "title", "value", "valid_from", F.array_join("tags", ",").alias("tags"), "confidence", "body", "problem")


@query(" SELECT id, type, title, subject, predicate, value, status, source, confidence, importance, valid_from, valid_to, hits, array_to_string(tags, ',') AS tags, array_to_string(aliases, ',') AS aliases, array_to_string(links, ',') AS links, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS recorded_at, strftime(last_hit, '%Y-%m-%d %H:%M:%S') AS last_hit, superseded_by, body, NULL::VARCHAR AS problem FROM claims")
def s4_round_trip(spark, sf_dir):
    back = S.parsed_cards(S.rendered(claims(spark, sf_dir)))
    return back.select("id", "type", "title", "subject", "predicate", "value", "status", "source", "confidence", "importance", "valid_from", "valid_to", "hits", *[F.array_join(k, ",").alias(k) for k in ("tags", "aliases", "links")], *[F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k) for k in ("recorded_at", "last_hit")], "superseded_by", "body", "problem")


@query(" SELECT id, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(slot, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295)) AS fnv FROM claims")
def t7_fnv(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.fnv1a(F.col("slot")).alias("fnv"))


@query(" SELECT id, slug, slug AS short FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM claims)")
def t8_slugs(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.slug(F.col("title")).alias("slug"), T.short_slug(F.col("title")).alias("short"))


@query(" SELECT slot, first(id ORDER BY recorded_at DESC, id DESC) AS newest, count(*) AS claims, count(*) > 1 AS conflict FROM claims WHERE status = 'active' GROUP BY slot")
def st3_slot_state(spark, sf_dir):
    return ST.slot_state(C.active(claims(spark, sf_dir))).select("slot", "newest", "claims", "conflict")


@query(" SELECT strftime(recorded_at, '%Y-%m-%d') AS start, type, count(*) AS n FROM claims GROUP BY 1, 2")
def st5_windows(spark, sf_dir):
    return ST.windowed(claims(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contested slots with their newest card."""
    return C.conflicts(claims(spark, sf_dir)).select("slot", "n", "kind", "newest")
