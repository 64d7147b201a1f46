"""Queries of sinks, sources and streams: what is written comes back as SQL says it was."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotwise.functions import temporal as D
from slotwise.functions import text as T
from slotwise.operators import agent as A
from slotwise.operators import cards as C
from slotwise.operators import records as R
from slotwise.operators import upkeep as U
from slotwise.operators.ordered import shared_folder
from slotwise.plans.queries import CONFLICTS_SQL, LINES_SQL, REF, TRUTH_SQL, _formatted, _texts, query
from slotwise.sources import cards as S
from slotwise.sources import sinks
from slotwise.sources import table as TB
from slotwise.sources.claims import claims
from slotwise.streaming import stream as ST


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _finished(q):
    """Wait for a stream over what is there; its failure is raised."""
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


# --- card files --------------------------------------------------------------------------------

CARD_SQL = " SELECT id, subject, predicate, value, status, array_to_string(tags, ',') AS tags, body FROM claims"


@query(CARD_SQL)
def sk1_card_files(spark, sf_dir):
    at = _folder(spark)
    sinks.write_card_files(claims(spark, sf_dir), at)
    return S.parsed_cards(sinks.read_card_files(spark, at)).select("id", "subject", "predicate", "value", "status", F.array_join("tags", ",").alias("tags"), "body")


@query(" SELECT type, count(*) AS n, sum(num)::BIGINT AS nums FROM claims GROUP BY type")
def sk2_card_table(spark, sf_dir):
    at = _folder(spark)
    S.write_cards(claims(spark, sf_dir), at)
    return spark.read.parquet(at).groupBy("type").agg(F.count("*").alias("n"), F.sum("num").alias("nums"))


@query(" SELECT subject || '.md' AS name, 'too long' AS problem FROM claims WHERE 1 = 0 UNION ALL SELECT subject, CASE WHEN n % 3 = 0 THEN 'no_front_matter' WHEN n % 3 = 1 THEN 'no_id' END FROM (SELECT subject, count(*) AS n FROM claims GROUP BY subject)")
def s1_scanned_files(spark, sf_dir):
    """Whole files of a folder and its subfolders: cards, texts without front matter, cards without an id, and files that are passed over."""
    n = claims(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))
    text = F.when(F.col("n") % 3 == 0, F.lit("plain")).when(F.col("n") % 3 == 1, F.lit("---\ntitle: t\n---\nb")).otherwise(F.concat(F.lit("  \\---\r\nid: "), "subject", F.lit("\r\n---\r\nb")))
    name = F.concat(F.lit("f/"), F.regexp_replace("subject", ":", "_"), F.lit(".md"))
    skipped = spark.createDataFrame([("f/README.md", "x"), ("f/_draft.md", "x")], "path string, text string")
    files = n.select(name.alias("path"), text.alias("text")).unionByName(skipped)
    return S.parsed_cards(files).select(F.replace(F.regexp_extract("path", r"f/(.*)\.md", 1), F.lit("_"), F.lit(":")).alias("name"), "problem")


# --- logs, journals, tasks -----------------------------------------------------------------------

@query(" SELECT id, 'add' AS op, 2 AS n FROM claims")
def sk3_audit(spark, sf_dir):
    at = _folder(spark)
    for _ in range(2):
        sinks.append_audit(claims(spark, sf_dir).select("id", F.lit("add").alias("op")), at)
    return spark.read.schema("id string, op string").json(at).groupBy("id", "op").agg(F.count("*").cast("int").alias("n"))


@query(" SELECT strftime(recorded_at, '%Y-%m') AS month, strftime(recorded_at, '%d') AS day, '- ' || title AS value, count(*) AS n FROM claims GROUP BY 1, 2, 3")
def sk5_journal(spark, sf_dir):
    at = _folder(spark)
    sinks.append_journal(claims(spark, sf_dir).select(F.col("recorded_at").alias("at"), F.col("title").alias("line")), at)
    lines = spark.read.schema("value string, month string, day string").text(at)
    return lines.groupBy("month", "day", "value").agg(F.count("*").alias("n"))


@query(" SELECT CAST(source AS VARCHAR) AS source, count(*) + 1 AS records FROM k GROUP BY 1", LINES_SQL)
def sk6_task(spark, sf_dir):
    """A package's chunks have every record of every text, and the header record."""
    t = _texts(spark, sf_dir)
    lines = t.withColumn("text", F.array_join(F.transform(F.filter(F.split("text", "\r?\n", -1), lambda x: T.trimmed(x) != ""), lambda x: F.concat(F.lit("# "), T.trimmed(x))), "\n"))
    m = sinks.write_task(lines.where("text <> ''").withColumn("format", F.lit("markdown")), _folder(spark), 1_000_000)
    return m.groupBy("source").agg(F.sum("record_count").alias("records"))


@query(" SELECT id FROM claims WHERE status = 'active'")
def sk7_snapshot(spark, sf_dir):
    at = sinks.snapshot(C.active(claims(spark, sf_dir)).select("id"), _folder(spark), "2024-03-01")
    return spark.read.parquet(at)


@query(" SELECT id, to_json({'id': id, 'hits': hits}) AS line FROM claims")
def sk8_json_lines(spark, sf_dir):
    at = _folder(spark)
    claims(spark, sf_dir).select(F.to_json(F.struct("id", "hits")).alias("value")).write.text(at)
    return spark.read.text(at).select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("line"))


@query(CONFLICTS_SQL + " SELECT slot, n, newest, keeper FROM g")
def l1_updated_table(spark, sf_dir):
    """A table of some cards, a part of them old and some gone since, is brought up to date; conflicts are read from it by bucket."""
    name = f"cards_{uuid.uuid4().hex}"
    c = claims(spark, sf_dir)
    n = F.col("num")
    stale = c.where(n % 7 > 0).withColumn("value", F.when(n % 5 == 0, "old").otherwise(F.col("value"))).withColumn("slot", F.when(n % 35 == 5, "old::slot").otherwise(F.col("slot")))
    gone = c.where(n % 50 == 1).withColumn("id", F.concat(F.lit("gone_"), "id"))
    TB.build(stale.unionByName(gone), name, 4, 8)
    TB.update(spark, name, c.where((n % 7 == 0) | (n % 5 == 0)), gone.select("id"), 4, 8)
    return C.conflicts(TB.table(spark, name)).select("slot", "n", "newest", "keeper")


# --- dates, hashes, recipes ------------------------------------------------------------------------

@query(" SELECT id, CASE num % 4 WHEN 1 THEN strftime(recorded_at, '%Y-%m-%d %H:%M:00') WHEN 3 THEN NULL ELSE strftime(recorded_at + to_seconds(num % 60), '%Y-%m-%d %H:%M:%S') END AS recorded_at, CAST(recorded_at AS DATE) AS day FROM claims")
def dt1_parsed(spark, sf_dir):
    """Three of the accepted forms, and one that is none: a blank between day and time, without seconds."""
    pick = F.col("num") % 4
    at = F.timestamp_seconds(F.unix_timestamp("recorded_at") + F.col("num") % 60)
    shown = F.when(pick == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(pick == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm")).when(pick == 2, F.concat(F.lit(" "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    return claims(spark, sf_dir).select("id", F.date_format(D.parsed(shown), "yyyy-MM-dd HH:mm:ss").alias("recorded_at"), D.parsed(F.date_format(at, "yyyy-MM-dd")).cast("date").alias("day"))


@query(f" SELECT id, CASE num % 5 WHEN 0 THEN strftime({REF}, '%Y-%m-%d') WHEN 1 THEN strftime({REF} - INTERVAL 1 DAY, '%Y-%m-%d') WHEN 2 THEN strftime(recorded_at, '%Y-%m-%d') WHEN 3 THEN strftime({REF}, '%Y-%m-%d') ELSE 'soon' END AS day FROM claims")
def dt2_normalised(spark, sf_dir):
    n = F.col("num") % 5
    said = F.when(n == 0, "Today").when(n == 1, " yesterday").when(n == 2, F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss")).when(n == 3, "now").otherwise("soon")
    return claims(spark, sf_dir).select("id", D.normalized_date(said, F.lit("2024-03-01").cast("date")).alias("day"))


@query(" SELECT id, contains(value, 'no longer') AS changed, contains(value, 'as of') AS restated FROM claims")
def t10_phrases(spark, sf_dir):
    from slotwise.config import CHANGE, RESTATE

    return claims(spark, sf_dir).select("id", F.col("value").rlike("(?i)" + CHANGE).alias("changed"), F.col("value").rlike("(?i)" + RESTATE).alias("restated"))


@query(" SELECT id, CASE num % 6 WHEN 0 THEN 'unknown_strategy' WHEN 1 THEN 'bad_path' WHEN 4 THEN 'unknown_strategy' END AS problem FROM claims")
def f15_recipes(spark, sf_dir):
    n = F.col("num") % 6
    strategy = F.when(n == 0, "magic").when(n == 2, "record_separator").when(n == 4, "separator").otherwise("jsonl")
    fields = F.when(n == 1, F.create_map(F.lit("t"), F.lit("a..b"))).when(n == 3, F.create_map(F.lit("t"), F.lit("a[].b_1.c"))).when(n == 5, F.create_map(F.lit("t"), F.lit("$a.b$")))
    return claims(spark, sf_dir).select("id", A.recipe_problem(strategy, fields).alias("problem"))


@query(" SELECT id, CASE WHEN num % 8 IN (5, 6) THEN 'no_json' WHEN num % 8 = 7 THEN 'no_cards' END AS error, CASE WHEN num % 8 >= 5 THEN NULL ELSE title END AS title FROM claims")
def n2_loose_results(spark, sf_dir):
    """One card in each of the shapes that results come in: bare, fenced, amid words, as a list, under other names; an object amid words and a bare one are none."""
    c = claims(spark, sf_dir)
    card = F.to_json(F.struct(F.col("title").alias("name"), F.lit("s").alias("subject")))
    n = F.col("num") % 8
    j = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    text = F.when(n == 0, j('{"cards": [', card, "]}")).when(n == 1, j("so:\n```json\n[", card, "]\n```\nend")).when(n == 2, j("It is (see below) ", '{"memories": [', card, "]} thanks"))
    text = text.when(n == 3, j('{"card": ', card, "}")).when(n == 4, j('{"a": 1, "found": [', card, "]}")).when(n == 6, j("I saw ", card, " there")).when(n == 7, card).otherwise(F.lit("nothing {here"))
    return A.extracted(c.select(F.col("id").alias("chunk"), text.alias("text"))).select(F.col("chunk").alias("id"), "error", "title")


@query("SELECT event_id AS source, CASE WHEN k = 'text' THEN 3 WHEN k = 'csv' THEN 3 WHEN k = 'log' THEN 3 WHEN k = 'json' THEN 1 WHEN k = 'yaml' THEN 6 ELSE 3 END AS lines, CASE k WHEN 'jsonl' THEN 1.0 WHEN 'json' THEN 1.0 ELSE 0.0 END::DOUBLE AS json_line_rate, k = 'csv' AS csv_like, CASE WHEN k = 'csv' THEN 3 ELSE 1 END AS csv_columns, CASE WHEN k = 'yaml' THEN 3 ELSE 0 END AS yaml_keys, CASE WHEN k = 'yaml' THEN 0.5 ELSE 0.0 END::DOUBLE AS indented_rate, CASE WHEN k = 'log' THEN 1.0 ELSE 0.0 END::DOUBLE AS stamp_rate, k = 'json' AS json_valid, CASE WHEN k = 'json' THEN 'a' END AS json_root FROM (SELECT event_id, ['log', 'jsonl', 'yaml', 'csv', 'json', 'text'][event_id % 6 + 1] AS k FROM events)", None)
def s8_structure(spark, sf_dir):
    return S.structure(_formatted(spark, sf_dir)).select("source", "lines", "json_line_rate", "csv_like", "csv_columns", "yaml_keys", "indented_rate", "stamp_rate", "json_valid", "json_root")


@query(" SELECT source, count(*) AS records, sum(length(text))::BIGINT AS chars, floor(avg(length(text)) + 0.5)::BIGINT AS avg_chars, max(lines)::INTEGER AS lines FROM k JOIN (SELECT doc_id AS source, len(regexp_split_to_array(text, '\\r?\\n')) AS lines FROM documents) USING (source) GROUP BY source", LINES_SQL)
def a17_with_lines(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return R.file_stats(R.by_lines(t), t).where("records > 0")


@query(" SELECT id, title FROM claims WHERE id IN ('mem_00003', 'mem_00042')")
def s2_lookup(spark, sf_dir):
    return C.with_id(claims(spark, sf_dir), ["mem_00042", "mem_00003", "mem_none"]).select("id", "title")


@query(" SELECT id, relation, target FROM (SELECT id, CASE WHEN num % 9 = 1 THEN split_part(links[1], ':', 1) ELSE split_part(links[1], ':', 2) END AS relation, CASE WHEN num % 9 = 1 THEN split_part(links[1], ':', 2) ELSE split_part(links[1], ':', 1) END AS target FROM claims WHERE len(links) > 0)")
def n6_links(spark, sf_dir):
    return U.link_ends(claims(spark, sf_dir))


# --- streams -----------------------------------------------------------------------------------------

def _log(spark, sf_dir):
    """An append log of claims, and its stream."""
    at = _folder(spark)
    c = claims(spark, sf_dir).select("id", "type", "slot", "value", "recorded_at", "hits")
    c.write.json(f"{at}/log", timestampFormat="yyyy-MM-dd'T'HH:mm:ss")
    return at, ST.audit_stream(spark, f"{at}/log", "id string, type string, slot string, value string, recorded_at timestamp, hits int")


@query(" SELECT id, hits, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS recorded_at FROM claims")
def st1_upserts(spark, sf_dir):
    """Each id twice, its newer row to be kept, through a stream into an upsert sink."""
    at, log = _log(spark, sf_dir)
    old = log.withColumns({"recorded_at": F.col("recorded_at") - F.expr("INTERVAL 1 DAY"), "hits": F.lit(-1)})
    _finished(log.unionByName(old).writeStream.foreachBatch(ST.upsert(f"{at}/table")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start())
    return ST.upserted(spark, f"{at}/table").select("id", "hits", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"))


@query(" SELECT slot, first(id ORDER BY recorded_at DESC, id DESC) AS newest, count(*) AS claims FROM claims GROUP BY slot")
def st3_slot_stream(spark, sf_dir):
    at, log = _log(spark, sf_dir)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{at}/state")

    _finished(ST.slot_state(log).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start())
    return spark.read.parquet(f"{at}/state").select("slot", "newest", "claims")


@query(" SELECT id, count(*) FILTER (hits > 0) AS cards, count(*) FILTER (hits = 0) AS errors FROM claims GROUP BY id")
def st5_progress_stream(spark, sf_dir):
    at, log = _log(spark, sf_dir)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{at}/state")

    results = log.select(F.col("id").alias("chunk"), F.when(F.col("hits") == 0, "no_cards").alias("error"))
    _finished(ST.progress_stream(results).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start())
    return spark.read.parquet(f"{at}/state").select(F.col("chunk").alias("id"), "cards", "errors")


TTL_SQL = "recorded_at + to_hours(2 + num % 200)"


@query(f", last AS (SELECT max(recorded_at) AS now FROM claims) SELECT id, strftime({TTL_SQL}, '%Y-%m-%d %H:%M:%S') AS expires_at FROM claims, last WHERE num % 10 <> 3 AND {TTL_SQL} + INTERVAL 1 MINUTE <= now")
def st2_expirations(spark, sf_dir):
    """Cards that live some hours, by timers of a stream; every tenth has no end.  What ends within the last minute may still be open."""
    at, log = _log(spark, sf_dir)
    num = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    # to the minute, as recorded
    until = F.when(num % 10 != 3, F.timestamp_seconds(F.unix_timestamp("recorded_at") + 3600 * (2 + num % 200)))
    with ST.timed_state(spark):
        q = ST.expirations(log.withColumn("expires_at", until)).writeStream.outputMode("append").format("parquet").option("path", f"{at}/gone").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
        _finished(q)
    now = claims(spark, sf_dir).agg(F.max("recorded_at").alias("_now"))
    gone = spark.read.parquet(f"{at}/gone").crossJoin(now).where(F.col("expires_at") + F.expr("INTERVAL 1 MINUTE") <= F.col("_now"))
    return gone.select("id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query(TRUTH_SQL.replace("AND num % 11 <> 0", "").replace("CASE WHEN num % 2 = 1 THEN CAST(valid_from AS TIMESTAMP) END", "CAST(valid_from AS TIMESTAMP)") + " SELECT * FROM truth")
def st3_truth_changes(spark, sf_dir):
    """Every card is active first and gets its own state later; the changes of all slots, folded."""
    at = _folder(spark)
    c = claims(spark, sf_dir).select("id", "num", "slot", "status", F.col("valid_from").cast("timestamp").alias("since"))
    c.withColumn("status", F.lit("active")).withColumn("version", F.lit(1).cast("long")).write.parquet(f"{at}/log/a")
    c.withColumn("version", F.col("num") + 1).write.parquet(f"{at}/log/b")
    log = spark.readStream.schema("id string, num long, slot string, status string, since timestamp, version long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(f"{at}/log")

    def keep(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/changes/b{number:09d}")

    with ST.timed_state(spark):
        _finished(ST.truth_changes(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start())
    return ST.folded_changes(spark.read.parquet(f"{at}/changes/b*"))


@query("SELECT n_name AS chunk, CASE n_nationkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'error' ELSE CASE WHEN n > 0 THEN 'ok' ELSE 'error' END END AS state, CASE WHEN n_nationkey % 3 = 2 THEN least(n, 60) ELSE 0 END AS cards FROM (SELECT n_name, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)", None)
def st5_result_files(spark, sf_dir):
    """A chunk a nation, its result a file that has a card for each customer, or none, or is no JSON, or isn't there."""
    at = _folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    card = F.struct(F.col("c_name").alias("title"), F.lit("lesson").alias("type"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").groupBy("c_nationkey").agg(F.slice(F.collect_list(card), 1, 100).alias("cards"))
    result = F.when(F.col("n_nationkey") % 3 == 1, "I found nothing to say").otherwise(F.to_json(F.struct(F.coalesce("cards", F.array().cast("array<struct<title:string,type:string>>")).alias("cards"))))
    files = nation.where("n_nationkey % 3 > 0").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("chunk"), result.alias("value"))
    files.repartition("chunk").write.partitionBy("chunk").text(f"{at}/results")
    _finished(ST.task_progress(ST.result_files(spark, f"{at}/results", r"chunk=([^/]+)/"), nation.select(F.col("n_name").alias("chunk")), f"{at}/state", f"{at}/cp"))
    return spark.read.parquet(f"{at}/state")
