"""Card views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import text as T

REF_TS = "2024-03-01 00:00:00"


#: Of every so many events one is about the same slot; others change or restate a claim, have links, or a successor.
HOT, CHANGED, RESTATED = 200, 7, 3


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card for each event; some share a hot slot, change claims, are linked, closed or of unclean fields."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hot, every = F.col("event_id") % HOT == 0, lambda n: F.col("event_id") % n == 0
    bucket = F.pmod("event_id", F.lit(10))
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'profile' WHEN 'view' THEN 'preference' WHEN 'click' THEN 'episode' WHEN 'purchase' THEN 'decision' WHEN 'error' THEN 'lesson' ELSE 'note' END")
    df = e.select(
        F.format_string("mem_%05d", F.col("event_id") + 1).alias("id"), (F.col("event_id") + 1).alias("num"), kind.alias("type"),
        F.concat(F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string")).alias("title"),
        F.when(hot, "team:all").otherwise(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("subject"),
        F.when(hot, "reply_style").when(every(97), F.concat(F.lit("bad "), "event_type")).otherwise(F.concat(F.col("event_type"), F.lit("_d"), F.date_format("ts", "yyyyMMdd"))).alias("predicate"),
        F.concat(F.when(every(CHANGED), "no longer ").otherwise(""), F.when(every(RESTATED), "as of now ").otherwise(""), F.lit("k="), F.get_json_object("props", "$.k")).alias("value"),
        F.expr("CASE WHEN event_id % 10 < 7 THEN 'active' WHEN event_id % 10 = 7 THEN 'superseded' WHEN event_id % 10 = 8 THEN 'expired' ELSE 'disputed' END").alias("status"),
        (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"), (F.pmod(F.col("event_id") * 7, F.lit(100)) / 100.0).alias("importance"),
        F.to_date("ts").alias("valid_from"), F.when(bucket.isin(1, 7, 8), F.date_add(F.to_date("ts"), 20)).alias("valid_to"),
        F.date_trunc("minute", "ts").alias("recorded_at"), F.concat(F.lit("src"), F.pmod("event_id", F.lit(3)).cast("string")).alias("source"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(5)).cast("string"))).alias("tags"),
        F.pmod("event_id", F.lit(7)).cast("int").alias("hits"),
        F.array(F.concat(F.col("event_type"), F.lit(" card")), F.concat(F.lit("number "), F.pmod("event_id", F.lit(11)).cast("string"))).alias("aliases"),
        F.when(every(9), F.array(F.concat(F.lit("extends:"), F.format_string("mem_%05d", F.col("event_id") * 2)))).when(F.col("event_id") % 9 == 1, F.array(F.concat(F.format_string("mem_%05d", F.col("event_id") * 3), F.lit(":refines")))).otherwise(F.array().cast("array<string>")).alias("links"),
        F.when(every(4), F.date_trunc("minute", "ts") + F.expr("INTERVAL 30 DAYS")).alias("last_hit"),
        F.when((bucket == 7) & every(3), F.format_string("mem_%05d", "event_id")).alias("superseded_by"),
        F.concat(F.col("event_type"), F.lit(" of "), F.floor("value").cast("string"), F.lit(" units by user "), F.col("user_id").cast("string")).alias("body"),
    )
    return df.withColumn("slot", T.slot(F.col("subject"), F.col("predicate"))).withColumn("digest", T.digest(F.col("slot"), F.col("value"), F.col("body")))


CLAIMS_SQL = """
WITH base AS (
  SELECT printf('mem_%05d', event_id + 1) AS id, event_id + 1 AS num,
    CASE event_type WHEN 'signup' THEN 'profile' WHEN 'view' THEN 'preference' WHEN 'click' THEN 'episode' WHEN 'purchase' THEN 'decision' WHEN 'error' THEN 'lesson' ELSE 'note' END AS type,
    event_type || ' by ' || CAST(user_id AS VARCHAR) AS title, CASE WHEN event_id % 200 = 0 THEN 'team:all' ELSE 'user:' || CAST(user_id AS VARCHAR) END AS subject,
    CASE WHEN event_id % 200 = 0 THEN 'reply_style' WHEN event_id % 97 = 0 THEN 'bad ' || event_type ELSE event_type || '_d' || strftime(ts, '%Y%m%d') END AS predicate,
    CASE WHEN event_id % 7 = 0 THEN 'no longer ' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'as of now ' ELSE '' END || 'k=' || json_extract_string(props, '$.k') AS value,
    CASE WHEN event_id % 10 < 7 THEN 'active' WHEN event_id % 10 = 7 THEN 'superseded' WHEN event_id % 10 = 8 THEN 'expired' ELSE 'disputed' END AS status,
    (event_id % 100) / 100.0::DOUBLE AS confidence, ((event_id * 7) % 100) / 100.0::DOUBLE AS importance,
    CAST(ts AS DATE) AS valid_from, CASE WHEN event_id % 10 IN (1, 7, 8) THEN CAST(ts AS DATE) + 20 END AS valid_to,
    date_trunc('minute', ts) AS recorded_at, 'src' || CAST(event_id % 3 AS VARCHAR) AS source,
    [event_type, 'k' || CAST(event_id % 5 AS VARCHAR)] AS tags, CAST(event_id % 7 AS INTEGER) AS hits,
    [event_type || ' card', 'number ' || CAST(event_id % 11 AS VARCHAR)] AS aliases,
    CASE WHEN event_id % 9 = 0 THEN ['extends:' || printf('mem_%05d', event_id * 2)] WHEN event_id % 9 = 1 THEN [printf('mem_%05d', event_id * 3) || ':refines'] ELSE [] END AS links,
    CASE WHEN event_id % 4 = 0 THEN date_trunc('minute', ts) + INTERVAL 30 DAY END AS last_hit,
    CASE WHEN event_id % 10 = 7 AND event_id % 3 = 0 THEN printf('mem_%05d', event_id) END AS superseded_by,
    event_type || ' of ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' units by user ' || CAST(user_id AS VARCHAR) AS body
  FROM events),
slotted AS (SELECT *, lower(trim(subject)) || '::' || lower(trim(predicate)) AS slot FROM base),
claims AS (SELECT *, substr(sha1(slot || '|' || lower(trim(value)) || '|' || trim(body)), 1, 16) AS digest FROM slotted)
"""
