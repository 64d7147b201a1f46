"""Queries of splitters, upkeep and reports with their SQL; texts are made out of the tables' rows, so SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.operators import agent as A
from slotwise.operators import intake as I
from slotwise.operators import records as R
from slotwise.operators import upkeep as U
from slotwise.operators import cards as C
from slotwise.plans.queries import BASELINE_SQL, COLD_SQL, CONFLICTS_SQL, EXPIRY_REF, HARD_SQL, LINES_SQL, PROBLEMS_SQL, TRIM_SQL, TYPES_SQL, _formatted, _halves, _texts, query
from slotwise.sources import cards as S
from slotwise.sources import sinks
from slotwise.sources.claims import claims

SEQ = "(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER"


def _event_texts(spark, sf_dir, row, before="", after="", between="\n"):
    """(source, text): a text a user out of a row for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    g = e.groupBy(F.col("user_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("event_id", row(e).alias("t")))).alias("r"))
    return g.select("source", F.concat(F.lit(before), F.array_join(F.transform("r", lambda x: x["t"]), between), F.lit(after)).alias("text"))


def _turn_texts(spark, sf_dir, between, role=False):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")) if role else F.col("text")
    g = c.groupBy(F.col("conv_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))).alias("r"))
    return g.select("source", F.array_join(F.transform("r", lambda x: x["t"]), between).alias("text"))


def _object(_):
    return F.to_json(F.struct("event_id", "event_type", F.struct("k").alias("props")))


# --- splitters -------------------------------------------------------------------------------

TURNS_SQL = "SELECT conv_id AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, "


@query(TURNS_SQL + "role AS section, trim('## ' || role || chr(10) || text) AS text FROM conversations", None)
def r1_markdown(spark, sf_dir):
    return R.markdown(_turn_texts(spark, sf_dir, "\n", role=True)).select("source", "seq", "section", "text")


#: Paragraphs; those over 4000 characters by sentences, refilled by a fold in recursion.
SENTENCES_SQL = rf"""WITH RECURSIVE b AS (SELECT doc_id AS source, unnest(regexp_split_to_array(text, '\n\s*\n')) AS block, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS pos FROM documents),
 s AS (SELECT source, pos, unnest(regexp_extract_all(block, '(?s)[^。！？.!?;；\n]*[。！？.!?;；\n]|[^。！？.!?;；\n]+$')) AS t, generate_subscripts(regexp_extract_all(block, '(?s)[^。！？.!?;；\n]*[。！？.!?;；\n]|[^。！？.!?;；\n]+$'), 1) AS i FROM b WHERE length(block) > 4000),
 fold AS (SELECT source, pos, i, length(t) AS used, 0 AS piece FROM s WHERE i = 1 UNION ALL
  SELECT source, pos, i, CASE WHEN full_ THEN n ELSE used + n END, piece + full_::INTEGER FROM (SELECT s.source, s.pos, s.i, length(s.t) AS n, f.used, f.piece, f.used + length(s.t) > 4000 AS full_ FROM fold f JOIN s ON s.source = f.source AND s.pos = f.pos AND s.i = f.i + 1)),
 parts AS (SELECT source, pos, 0 AS piece, block AS t FROM b WHERE length(block) <= 4000 UNION ALL SELECT source, pos, piece, string_agg(t, '' ORDER BY i) FROM fold JOIN s USING (source, pos, i) GROUP BY 1, 2, 3),
 trimmed AS (SELECT source, pos, piece, {TRIM_SQL.format('t')} AS text FROM parts)"""


@query(" SELECT source, (row_number() OVER (PARTITION BY source ORDER BY pos, piece) - 1)::INTEGER AS seq, length(text)::INTEGER AS chars, sha1(text) AS sha FROM trimmed WHERE text <> ''", SENTENCES_SQL)
def r2_sentences(spark, sf_dir):
    return R.by_sentences(_texts(spark, sf_dir)).select("source", "seq", "chars", F.sha1(F.col("text").cast("binary")).alias("sha"))


@query(f"""SELECT user_id AS source, {SEQ} AS seq, section, CASE event_id % 3 WHEN 0 THEN '[' ELSE '(' END || section || ') ' || event_type || chr(10) || ' at 10:00' AS text
 FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%H:%M:%S') END AS section FROM events)""", None)
def r3_log(spark, sf_dir):
    """Lines with a day and time, with a day alone, with a time alone, in brackets of either kind and behind blanks; others go on."""
    k = F.col("event_id") % 3
    at = F.when(k == 0, F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).when(k == 1, F.concat(F.lit("  ("), F.date_format("ts", "yyyy/MM/dd"))).otherwise(F.concat(F.lit("("), F.date_format("ts", "HH:mm:ss")))
    row = lambda _: F.concat(at, F.lit(") "), "event_type", F.lit("\n at 10:00"))
    return R.log_lines(_event_texts(spark, sf_dir, row)).select("source", "seq", "section", "text")


K_SQL = "json_extract_string(props, '$.k')"


@query(f"SELECT user_id AS source, {SEQ} AS seq, 'event_type: ' || event_type || chr(10) || 'event_id: ' || CAST(event_id AS VARCHAR) AS text FROM events", None)
def r4_json_walk(spark, sf_dir):
    row = lambda _: F.to_json(F.struct("event_id", "event_type"))
    return R.json_walk(_event_texts(spark, sf_dir, row, "[", "]", ",")).select("source", "seq", "text")


@query(f"SELECT user_id AS source, {SEQ} AS seq, 'event_type: ' || event_type AS text FROM events", None)
def r5_json_lines(spark, sf_dir):
    return R.json_lines(_event_texts(spark, sf_dir, _object)).select("source", "seq", "text")


@query(f"SELECT user_id AS source, {SEQ} AS seq, CASE event_id % 3 WHEN 0 THEN 'event_' || event_id WHEN 1 THEN '[event_' || event_id || ']' ELSE 'event_' || event_id || '  ' || event_type END AS section FROM events", None)
def r6_yaml(spark, sf_dir):
    name, k = F.concat(F.lit("event_"), F.col("event_id").cast("string")), F.col("event_id") % 3
    head = F.when(k == 0, F.concat(name, F.lit(":"))).when(k == 1, F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(name, F.lit(": "), "event_type"))
    row = lambda _: F.concat(head, F.lit("\n  type: "), "event_type")
    return R.yaml_blocks(_event_texts(spark, sf_dir, row)).select("source", "seq", "section")


@query(f"SELECT user_id AS source, {SEQ} AS seq, 'event_id: ' || CAST(event_id AS VARCHAR) || chr(10) || 'note: ' || event_type || ', \"so\"' || chr(10) || 'col3: x' AS text FROM events", None)
def r7_csv(spark, sf_dir):
    row = lambda _: F.concat(F.col("event_id").cast("string"), F.lit(',"'), "event_type", F.lit(', ""so""",x'))
    return R.csv_rows(_event_texts(spark, sf_dir, row, "event_id,note\n")).select("source", "seq", "text")


@query("""SELECT event_id AS source, 0 AS seq, 'file-meta' AS kind, 'file: ' || event_id || chr(10) || 'format: csv' || chr(10) || 'records: 2' AS text FROM events UNION ALL SELECT event_id, 1, 'text', 'title ' || event_id FROM events UNION ALL SELECT event_id, 2, 'text', 'it was a ' || event_type FROM events""", None)
def r7_no_delimiter(spark, sf_dir):
    """What is called CSV and has no delimiter in its first line is cut into paragraphs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit("\n"), F.lit("title "), F.col("event_id").cast("string"), F.lit("\n\nit was a "), "event_type")
    return R.by_rules(e.select(F.col("event_id").alias("source"), text.alias("text"), F.lit("csv").alias("format"))).select("source", "seq", "kind", "text")


def _recipe(texts, fields):
    return texts.withColumn("fields", F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])).withColumn("meta", F.array().cast("array<string>"))


RENDERED_SQL = f"SELECT user_id AS source, {SEQ} AS seq, 'type: ' || event_type || chr(10) || 'k: ' || {K_SQL} AS text FROM events"


@query(RENDERED_SQL, None)
def r9_jsonl_recipe(spark, sf_dir):
    return R.jsonl_by_recipe(_recipe(_event_texts(spark, sf_dir, _object), {"type": "event_type", "k": "props.k"})).select("source", "seq", "text")


@query(RENDERED_SQL, None)
def r10_json_array(spark, sf_dir):
    return R.json_array(_recipe(_event_texts(spark, sf_dir, _object, "[", "]", ","), {"type": "event_type", "k": "props.k"})).select("source", "seq", "text")


@query(TURNS_SQL + "trim(text) AS text FROM conversations", None)
def r12_separator(spark, sf_dir):
    return R.by_separator(_turn_texts(spark, sf_dir, "\n---\n")).select("source", "seq", "text")


@query(r"""WITH m AS (SELECT conv_id AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, trim(text) AS t, CASE WHEN role = 'user' THEN 'Q.' ELSE 'A*' END AS mark FROM conversations)
 SELECT source, seq, CASE WHEN source % 3 = 2 THEN 'conversation' ELSE 'block' END AS kind, CASE WHEN source % 3 = 2 THEN mark || ':' || chr(10) || regexp_replace(t, '\s+', ' ', 'g') ELSE t END AS text FROM m""", None)
def r15_separators(spark, sf_dir):
    """Separators and markers of recipes, with signs that patterns read otherwise; a recipe without one has the usual one."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.col("conv_id") % 3
    t = F.when(k == 2, F.concat(F.when(F.col("role") == "user", "q. ").otherwise(" a*：").cast("string"), F.regexp_replace(F.trim("text"), r"\s+", " "))).otherwise(F.trim("text"))
    said = F.array_sort(F.collect_list(F.struct("turn", t.alias("t"))))
    g = c.groupBy(F.col("conv_id").alias("source")).agg(said.alias("r"))
    k = F.col("source") % 3
    between = F.when(k == 0, "\n---\n").when(k == 1, "|=.*\\E|").otherwise("\n")
    texts = g.select("source", F.array_join(F.transform("r", lambda x: F.concat(x["t"], between)), "").alias("text"), F.when(k == 2, "conversation").otherwise("record_separator").alias("strategy"), F.when(k == 1, between).when(k == 2, "Q.| A* |").alias("separator"))
    return R.by_recipe(texts).select("source", "seq", "kind", F.when(k == 2, F.regexp_replace(F.regexp_replace("text", "^q", "Q"), "^a", "A")).otherwise(F.col("text")).alias("text"))


@query(r"SELECT source, (row_number() OVER (PARTITION BY source ORDER BY pos) - 1)::INTEGER AS seq, trim(t) AS text FROM (SELECT doc_id AS source, unnest(regexp_split_to_array(text, '\n\s*\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS pos FROM documents) WHERE regexp_replace(t, '\s', '', 'g') <> ''", None)
def r13_paragraphs(spark, sf_dir):
    return R.by_blank_lines(_texts(spark, sf_dir)).select("source", "seq", "text")


@query(" SELECT source, 'line' AS kind, count(*) AS n FROM k WHERE source % 2 = 0 AND regexp_replace(text, '[\\s\\p{P}]', '', 'g') <> '' GROUP BY source UNION ALL SELECT doc_id, 'whole', 1 FROM documents WHERE doc_id % 2 = 1 AND regexp_replace(text, '[\\s\\p{P}]', '', 'g') <> ''", LINES_SQL)
def r15_recipes(spark, sf_dir):
    t = _texts(spark, sf_dir).withColumn("strategy", F.when(F.col("source") % 2 == 0, "lines").otherwise("magic"))
    return R.by_recipe(t).groupBy("source", "kind").agg(F.count("*").alias("n"))


RULES_SQL = """ SELECT event_id AS source, 0 AS seq, 'file-meta' AS kind, 'file: ' || event_id || chr(10) || 'format: ' || ['log', 'jsonl', 'yaml', 'csv', 'json', 'text'][event_id % 6 + 1] || chr(10) || 'records: ' || [3, 3, 3, 2, 1, 1][event_id % 6 + 1] AS text FROM events
 UNION ALL SELECT event_id, p, ['log', 'jsonl-line', 'yaml', 'csv', 'text-whole', 'text'][event_id % 6 + 1],
  CASE event_id % 6 WHEN 0 THEN '2024-01-05 10:00:00 ' || event_id WHEN 1 THEN '{"a":' || event_id || '}' WHEN 2 THEN 'k' || event_id || ':' || chr(10) || '  v: 1' WHEN 3 THEN event_id || ': ' || event_id || chr(10) || 'b: b' || chr(10) || 'c: c' WHEN 4 THEN '{"a": [' || event_id || ']}' WHEN 5 THEN 'words and ' || event_id || chr(10) || 'words and ' || event_id || chr(10) || 'words and ' || event_id END
  FROM events, LATERAL (SELECT unnest(range(1, 1 + [3, 3, 3, 2, 1, 1][event_id % 6 + 1]))::INTEGER AS p)"""


@query(RULES_SQL, None)
def r16_rules(spark, sf_dir):
    texts = _formatted(spark, sf_dir)
    return R.by_rules(texts.withColumn("format", S.sniffed(F.col("text"), F.lit("x")))).select("source", "seq", "kind", "text")


@query(""" SELECT event_id AS source, 'lines' AS strategy, 1 AS chunks FROM events WHERE event_id % 3 = 0 UNION ALL
 SELECT event_id, 'fallback:' || ['log', 'jsonl', 'yaml', 'csv', 'json', 'text'][event_id % 6 + 1], 2 FROM events WHERE event_id % 3 > 0""", None)
def u7_recipe_chunks(spark, sf_dir):
    """Sources without a recipe, and those with a bad one, go by the rules of their format."""
    strategy = F.when(F.col("source") % 3 == 0, "lines").when(F.col("source") % 3 == 1, "magic")
    texts = _formatted(spark, sf_dir).withColumn("format", S.sniffed(F.col("text"), F.lit("x"))).withColumn("strategy", strategy)
    c = R.chunks_by_recipe(texts)
    return c.groupBy("source", "strategy").agg(F.count("*").cast("int").alias("chunks"))


@query(" SELECT id AS source, '[card ' || id || ']' || chr(10) || 'type: ' || type || chr(10) || 'title: ' || title || chr(10) || 'slot: ' || subject || '::' || predicate || chr(10) || 'value: ' || value || CASE WHEN status <> 'active' THEN chr(10) || 'status: ' || status ELSE '' END || chr(10) || 'tags: ' || array_to_string(tags, ', ') || chr(10) || 'aliases: ' || array_to_string(aliases, ', ') || chr(10) || 'body:' || chr(10) || body AS text FROM claims")
def r17_card_records(spark, sf_dir):
    return R.of_cards(claims(spark, sf_dir)).select("source", "text")


@query(" SELECT source, seq, p::INTEGER AS part, (CASE WHEN n = 1 THEN length(text) ELSE least(85, length(text) - p * 85) END)::INTEGER AS chars, CASE WHEN n > 1 THEN 'line-part' ELSE 'line' END AS kind, 'L' || seq || CASE WHEN n > 1 THEN ' (part ' || (p + 1) || '/' || n || ')' ELSE '' END AS locator FROM (SELECT *, CASE WHEN length(text) > 100 THEN ceil(length(text) / 85.0)::INTEGER ELSE 1 END AS n FROM k), LATERAL (SELECT unnest(range(n)) AS p)", LINES_SQL)
def k2_slices(spark, sf_dir):
    lines = R.by_lines(_texts(spark, sf_dir)).withColumn("locator", F.concat(F.lit("L"), F.col("seq").cast("string")))
    return R.sliced(lines, 100).select("source", "seq", "part", "chars", "kind", "locator")


@query(" SELECT source, seq // 5 AS chunk, row_number() OVER (ORDER BY source, seq // 5) - 1 AS number FROM k GROUP BY 1, 2", LINES_SQL)
def k4_numbered(spark, sf_dir):
    return R.numbered_across(R.chunks(R.by_lines(_texts(spark, sf_dir)), 10_000_000, 5)).select("source", "chunk", "number")


@query(" SELECT source, seq, text FROM k WHERE source = 3 AND seq = 2", LINES_SQL)
def x10_chunk(spark, sf_dir):
    c = R.chunks(R.by_lines(_texts(spark, sf_dir)), 10_000_000, 1)
    found = R.chunk_of(c.withColumn("number", F.col("chunk")), "3-2")
    return found.select("source", F.col("chunk").alias("seq"), F.regexp_extract("text", r'(?s)\A<record id="2" loc="">\n(.*)\n</record>\z', 1).alias("text"))


# --- sources ---------------------------------------------------------------------------------

@query(f"SELECT doc_id AS source, length(text)::INTEGER AS chars, substr(text, 1, 3000) AS head, CASE WHEN length(text) > 4200 THEN right(text, 1200) END AS tail, 'text' AS format, len(ls)::INTEGER AS lines, len(list_filter(ls, lambda t: regexp_matches(t, '^#{{1,6}}\\s+')))::INTEGER AS headings FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda t: {TRIM_SQL.format('t')} <> '') AS ls FROM documents)", None)
def s9_samples(spark, sf_dir):
    return S.samples(_texts(spark, sf_dir)).select("source", "chars", "head", "tail", "format", "lines", "headings")


@query(r"SELECT coalesce(nullif(trim(regexp_extract(text, '(?m)^#+(.*)$', 1)), ''), CAST(doc_id AS VARCHAR)) AS title, 'import:' || CAST(doc_id AS VARCHAR) AS subject, 'import:' || CAST(doc_id AS VARCHAR) || '.md' AS source, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::INTEGER AS chars FROM documents WHERE trim(text) <> ''", None)
def s11_imported(spark, sf_dir):
    files = _texts(spark, sf_dir).select(F.concat(F.lit("notes/"), F.col("source").cast("string"), F.lit(".md")).alias("path"), "text")
    return sinks.imported(files, "2024-03-01").select("title", "subject", "source", F.length("body").alias("chars"))


@query(" SELECT 'map' || CAST(num % 50 AS VARCHAR) AS map, id FROM claims WHERE status <> 'active'")
def s12_stale_maps(spark, sf_dir):
    c = claims(spark, sf_dir)
    notes = c.groupBy((F.col("num") % 50).alias("m")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    maps = notes.select(F.concat(F.lit("map"), F.col("m").cast("string")).alias("map"), F.concat(F.lit("| "), F.array_join("ids", " | "), F.lit(" |")).alias("text"))
    return U.stale_maps(maps, c)


@query(r"SELECT source, (pos - 1)::INTEGER AS pos, trim(regexp_replace(t, '^[-* ]+|[-* ]+$', '', 'g')) AS line FROM (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(trim(regexp_replace(t, '^[-* ]+|[-* ]+$', '', 'g'))) > 12 AND NOT starts_with(trim(regexp_replace(t, '^[-* ]+|[-* ]+$', '', 'g')), '#')", None)
def s13_candidates(spark, sf_dir):
    return U.candidates(_texts(spark, sf_dir))


# --- upkeep ----------------------------------------------------------------------------------

@query(PROBLEMS_SQL + CONFLICTS_SQL + " SELECT 'type' AS measure, type AS key, count(*) AS n FROM claims GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM claims GROUP BY 2 UNION ALL SELECT 'conflict', CASE WHEN digests < n THEN 'duplicate' ELSE 'divergent' END, count(*) FROM g GROUP BY 2 UNION ALL SELECT 'problem', problem, count(*) FROM problems GROUP BY 2")
def a12_checkup(spark, sf_dir):
    return U.checkup(claims(spark, sf_dir))


@query(" SELECT count(*) AS ids, count(*) FILTER (n > 1) AS repeated, max(num) AS largest FROM (SELECT id, max(num) AS num, count(*) AS n FROM claims GROUP BY id)")
def s5_ids(spark, sf_dir):
    c = claims(spark, sf_dir)
    return c.agg(F.count_distinct("id").alias("ids")).crossJoin(U.duplicate_ids(c).agg(F.count("*").alias("repeated"))).crossJoin(U.largest_number(c))


@query("SELECT o_orderpriority AS source, CASE WHEN n % 3 = 0 THEN 'missing' WHEN n % 3 = 1 THEN 'invalid' ELSE 'ok' END AS state FROM (SELECT o_orderpriority, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS n FROM orders GROUP BY 1)", None)
def jj_recipe_progress(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("source")).distinct()
    n = F.substring("source", 1, 1).cast("int") % 3
    recipes = m.where(n > 0).select("source", F.when(n == 1, "magic").otherwise("lines").alias("strategy"), F.lit(None).cast("map<string,string>").alias("fields"))
    return A.recipe_progress(m, recipes).select("source", "state")


@query(CONFLICTS_SQL + """, m AS (SELECT slot, keeper FROM g WHERE digests < n), o AS (SELECT c.*, m.keeper, m.keeper IS NOT NULL AND status = 'active' AS part FROM claims c LEFT JOIN m USING (slot)),
 b AS (SELECT keeper AS k, string_agg(trim(body), chr(10) || chr(10) ORDER BY (id = keeper) DESC, valid_from DESC, num DESC) AS merged, sum(hits)::BIGINT AS total FROM o WHERE part GROUP BY keeper)
 SELECT id, CASE WHEN part AND id <> keeper THEN 'superseded' ELSE status END AS status, CASE WHEN part AND id <> keeper THEN keeper ELSE superseded_by END AS superseded_by, coalesce(total, hits) AS hits, coalesce(merged, body) AS body FROM o LEFT JOIN b ON part AND id = k""")
def l3_auto_merged(spark, sf_dir):
    return U.auto_merged(claims(spark, sf_dir), EXPIRY_REF).select("id", "status", "superseded_by", "hits", "body")


AGE_AT = f"greatest(0.0, (epoch(TIMESTAMP '{EXPIRY_REF}') - epoch(recorded_at)) / 86400.0)"


@query(f", {TYPES_SQL}" + CONFLICTS_SQL + f""", ends AS (SELECT id, CASE WHEN num % 9 = 1 THEN split_part(links[1], ':', 2) ELSE split_part(links[1], ':', 1) END AS target FROM claims WHERE status = 'active' AND len(links) > 0)
 SELECT 'expiring' AS kind, id, type AS detail FROM claims LEFT JOIN types USING (type) WHERE status = 'active' AND {AGE_AT} > floor(coalesce(ttl_days, 365) * (0.7 + 0.6 * importance))
 UNION ALL SELECT 'mergeable', keeper, slot FROM g WHERE digests < n
 UNION ALL SELECT 'archive', id, type FROM claims WHERE {COLD_SQL} UNION ALL SELECT 'orphan_link', id, target FROM ends WHERE target NOT IN (SELECT id FROM claims)
 UNION ALL SELECT 'stale_map', id, 'all' FROM claims WHERE status <> 'active'""")
def l5_sweep(spark, sf_dir):
    c = claims(spark, sf_dir)
    maps = c.select(F.lit("all").alias("map"), F.concat(F.lit("see "), "id").alias("text"))
    return U.sweep(c, EXPIRY_REF, maps)


ACTIONS = ("merge", "supersede", "keep-first", "dispute", "drop")


@query(""", d AS (SELECT slot, count(*) AS n, ['merge', 'supersede', 'keep-first', 'dispute', 'drop'][((count(*) + length(slot)) % 5 + 1)::BIGINT] AS a FROM claims GROUP BY slot HAVING count(*) > 1),
 r AS (SELECT c.*, a, n, row_number() OVER (PARTITION BY c.slot ORDER BY CASE a WHEN 'merge' THEN -(length(coalesce(body, '')) + length(coalesce(value, ''))) WHEN 'supersede' THEN -epoch_us(recorded_at) END NULLS LAST, num) AS r FROM claims c LEFT JOIN d USING (slot)),
 o AS (SELECT slot, string_agg(value || chr(10) || body, chr(10) || chr(10) ORDER BY r) AS others FROM r WHERE a = 'merge' AND r > 1 GROUP BY slot)
 SELECT id, CASE WHEN a = 'dispute' THEN 'disputed' ELSE status END AS status,
 CASE WHEN a = 'merge' THEN body || chr(10) || chr(10) || others || chr(10) || chr(10) || '> merged ' || CAST(n - 1 AS VARCHAR) || ' cards of this slot' WHEN a = 'supersede' THEN body || chr(10) || chr(10) || '> supersedes ' || CAST(n - 1 AS VARCHAR) || ' cards of this slot' ELSE body END AS body
 FROM r LEFT JOIN o USING (slot) WHERE a IS NULL OR a = 'dispute' OR a IN ('merge', 'supersede', 'keep-first') AND r = 1""")
def l6_decided(spark, sf_dir):
    c = claims(spark, sf_dir)
    at = (F.count("*") + F.length("slot")) % len(ACTIONS) + 1
    d = c.groupBy("slot").agg(F.element_at(F.array(*map(F.lit, ACTIONS)), at.cast("int")).alias("action"), F.count("*").alias("n"))
    return U.decided(c, d).select("id", "status", "body")


@query(" SELECT id, hits + 2 * (num % 3) AS hits, strftime(CASE WHEN num % 3 > 0 THEN greatest(last_hit, recorded_at + INTERVAL 3 DAY) ELSE last_hit END, '%Y-%m-%d %H:%M:%S') AS last_hit FROM claims")
def l7_used(spark, sf_dir):
    c = claims(spark, sf_dir)
    at = F.col("recorded_at") + F.expr("INTERVAL 3 DAYS")
    uses = c.select("id", F.explode(F.array_repeat(at, ((F.col("num") % 3) * 2).cast("int"))).alias("at"))
    return U.used(c, uses).select("id", "hits", F.date_format("last_hit", "yyyy-MM-dd HH:mm:ss").alias("last_hit"))


VERDICT_OF = "['dispute', 'supersede', 'merge', 'keep', 'archive', 'guess'][(length(slot) + n) % 6 + 1]"
RESOLVED_SQL = f""", d AS (SELECT slot, count(*) AS n FROM claims WHERE status IN ('active', 'disputed') GROUP BY slot HAVING count(*) > 1), e AS (SELECT slot, {VERDICT_OF} AS v FROM d),
 m AS (SELECT c.*, v, first_value(id) OVER (PARTITION BY slot ORDER BY type, id) AS keep FROM claims c JOIN e USING (slot) WHERE status IN ('active', 'disputed') AND v <> 'guess'),
 o AS (SELECT keep AS k, string_agg(trim(body), chr(10) || chr(10) ORDER BY type, id) AS others, sum(hits)::INTEGER AS more, string_agg(id, ',' ORDER BY type, id) AS ids FROM m WHERE id <> keep AND v IN ('supersede', 'merge') GROUP BY keep),
 r AS (SELECT m.*, others, more, ids, id <> keep AS loses FROM m LEFT JOIN o ON m.id = o.k)"""


@query(RESOLVED_SQL + """ SELECT id, CASE WHEN v = 'dispute' THEN 'disputed' WHEN v = 'archive' THEN 'archived' WHEN loses THEN 'superseded' WHEN v = 'keep' THEN 'active' ELSE status END AS status,
  CASE WHEN v = 'merge' AND NOT loses THEN trim(body) || chr(10) || chr(10) || others ELSE body END || CASE WHEN v IN ('merge', 'supersede') AND NOT loses THEN chr(10) || chr(10) || '> 裁决记录 2024-06-01: ok' ELSE '' END AS body,
  CASE WHEN v = 'merge' AND NOT loses THEN hits + more ELSE hits END AS hits, CASE WHEN v = 'merge' AND NOT loses THEN source || '|merged:' || ids ELSE source END AS source,
  CASE WHEN v IN ('merge', 'supersede') AND NOT loses THEN ids ELSE '' END AS supersedes, CASE WHEN v = 'dispute' THEN NULL WHEN loses AND v <> 'archive' THEN coalesce(valid_to, DATE '2024-06-01') ELSE valid_to END AS valid_to,
  CASE WHEN v IN ('merge', 'supersede') AND loses THEN keep WHEN v = 'dispute' OR v = 'keep' AND loses THEN NULL ELSE superseded_by END AS superseded_by FROM r
 UNION ALL SELECT id, status, body, hits, source, '', valid_to, superseded_by FROM claims WHERE id NOT IN (SELECT id FROM m)""")
def l2_resolved(spark, sf_dir):
    c = claims(spark, sf_dir)
    return U.resolved(c, _verdicts(c), EXPIRY_REF).select("id", "status", "body", "hits", "source", F.array_join(F.coalesce("supersedes", F.array().cast("array<string>")), ",").alias("supersedes"), "valid_to", "superseded_by")


def _verdicts(c):
    at = (F.length("slot") + F.count("*")) % 6 + 1
    d = c.where("status in ('active', 'disputed')").groupBy("slot").agg(F.count("*").alias("n"), F.element_at(F.array(*map(F.lit, (*U.VERDICTS, "guess"))), at.cast("int")).alias("verdict"))
    return d.where("n > 1").withColumn("note", F.lit("ok"))


@query(RESOLVED_SQL + " SELECT slot, 'unknown_verdict' AS error FROM e WHERE v = 'guess' UNION ALL SELECT 'nowhere::at all', 'no_members'")
def l2_errors(spark, sf_dir):
    c = claims(spark, sf_dir)
    return U.resolution_errors(c, _verdicts(c).select("slot", "verdict").unionByName(spark.createDataFrame([("nowhere::at all", "keep")], "slot string, verdict string")))


ADD_SQL = PROBLEMS_SQL + f""", new AS (SELECT * FROM claims WHERE num % 2 = 0), old AS (SELECT * FROM claims WHERE num % 2 = 1 AND status = 'active'), p AS (SELECT id, string_agg(problem, ',' ORDER BY problem) AS problems, bool_or({HARD_SQL}) AS hard FROM problems GROUP BY id),
 x AS (SELECT new.id, string_agg(old.id, ',' ORDER BY old.id) AS existing FROM new JOIN old USING (slot) GROUP BY new.id)"""


@query(ADD_SQL + " SELECT id, NOT coalesce(hard, false) AS ok, coalesce(problems, '') AS problems, coalesce(existing, '') AS existing, existing IS NOT NULL AS contested FROM new LEFT JOIN p USING (id) LEFT JOIN x USING (id)")
def l8_added(spark, sf_dir):
    c = claims(spark, sf_dir)
    a = I.added(c.where("num % 2 = 0"), c.where("num % 2 = 1"), EXPIRY_REF)
    return a.select("id", "ok", F.array_join("problems", ",").alias("problems"), F.array_join("existing", ",").alias("existing"), F.col("action").isNotNull().alias("contested"))


@query(" SELECT 'total' AS measure, 'all' AS key, count(*) AS n FROM claims UNION ALL SELECT 'type/status', type || '/' || status, count(*) FROM claims GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM claims GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM claims GROUP BY 2 UNION ALL SELECT 'contested', slot, count(*) FROM claims WHERE status = 'active' GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'review', id, 1 FROM claims WHERE status = 'active' AND confidence < 0.5 UNION ALL SELECT 'subject', split_part(subject, ':', 1), count(*) FROM claims WHERE status = 'active' GROUP BY 2 UNION ALL (SELECT 'hot', id, hits FROM claims WHERE status = 'active' ORDER BY hits DESC, num LIMIT 10)")
def a11_state(spark, sf_dir):
    return U.overview(claims(spark, sf_dir))


LIBRARY_SQL = " SELECT 'cards' AS measure, 'all' AS key, count(*) AS n FROM claims UNION ALL SELECT 'active', 'all', count(*) FROM claims WHERE status = 'active' UNION ALL SELECT 'slots', 'all', count(DISTINCT subject || '::' || predicate) FROM claims UNION ALL SELECT 'type', type, count(*) FROM claims GROUP BY 2"


@query(LIBRARY_SQL)
def a19_by_type(spark, sf_dir):
    return U.library(claims(spark, sf_dir))


@query(LIBRARY_SQL + " UNION ALL SELECT 'shared_slots', 'all', count(*) FROM (SELECT slot FROM claims GROUP BY slot HAVING count(*) > 1) UNION ALL SELECT 'status', status, count(*) FROM claims GROUP BY 2 UNION ALL SELECT 'problem', 'no_id', count(*) FROM claims WHERE num % 10 = 0")
def a13_doctor(spark, sf_dir):
    c = claims(spark, sf_dir)
    return U.doctor(c, c.where("num % 10 = 0").select("id", F.lit("no_id").alias("problem")))


@query(", s AS (SELECT * FROM claims WHERE status = 'active') SELECT 'type' AS measure, type AS key, count(*)::DOUBLE AS n FROM s GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'subject', split_part(subject, ':', 1), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'slots', 'all', count(DISTINCT subject || '::' || predicate) FROM s UNION ALL SELECT 'coverage', 'all', 0.3333 UNION ALL SELECT 'extracted', 'all', count(*) FROM claims UNION ALL SELECT 'valid', 'all', count(*) FROM claims WHERE num % 4 > 0 UNION ALL SELECT 'extracted_type', type, count(*) FROM claims GROUP BY 2")
def a14_report(spark, sf_dir):
    c = claims(spark, sf_dir)
    got = c.withColumn("predicate", F.when(F.col("num") % 4 > 0, F.col("predicate")))
    return U.trial_report(C.active(c), 300, 100, got)


@query(" SELECT type, n, row_number() OVER (ORDER BY n DESC, type)::INTEGER AS place FROM (SELECT type, count(*) AS n FROM claims GROUP BY type)")
def o5_types(spark, sf_dir):
    """The order is what is shown: places of the ordered rows, a row for each type."""
    place = F.row_number().over(W.orderBy(F.desc("n"), "type"))
    return C.types_by_count(claims(spark, sf_dir)).withColumn("place", place)


@query(BASELINE_SQL.replace(", base AS (SELECT * FROM grams", ", old AS (SELECT * FROM grams").replace("base.", "old.").replace("JOIN base", "JOIN old") + " SELECT new_id, CASE WHEN similarity >= 0.93 THEN 'identical' WHEN similarity >= 0.7 THEN 'enrichment' ELSE 'contradiction' END AS kind, similarity FROM best WHERE r = 1 ORDER BY CASE WHEN similarity >= 0.93 THEN 2 WHEN similarity >= 0.7 THEN 1 ELSE 0 END, similarity, slot, new_id LIMIT 40")
def o4_first_conflicts(spark, sf_dir):
    return C.in_order(C.against_baseline(*_halves(spark, sf_dir))).limit(40).select("new_id", "kind", "similarity")


@query(f", {TYPES_SQL} SELECT type, count(*) AS n, count(*) FILTER (NOT (type = 'note' OR contains(predicate, ' ') OR coalesce(valid_to < valid_from, false) OR status = 'active' AND valid_to IS NOT NULL)) AS ok FROM claims GROUP BY type")
def x8_preview(spark, sf_dir):
    c = claims(spark, sf_dir)
    used = c.where("num % 5 = 0").select("id")
    return I.export_preview(c.withColumn("ord", F.col("num")), used, 10).select("type", "n", "ok")


@query(", t AS (SELECT id, CASE WHEN num % 3 = 0 THEN 'memo' ELSE type END AS type, value, body FROM claims) SELECT id, type <> 'note' AND type <> 'memo' AS kept FROM t")
def s14_results(spark, sf_dir):
    """Extractor results in JSON, a card each; a third has a type that there is none of."""
    c = claims(spark, sf_dir)
    kind = F.when(F.col("num") % 3 == 0, "memo").otherwise(F.col("type"))
    obj = F.to_json(F.struct(kind.alias("category"), F.col("title").alias("name"), F.col("slot"), F.col("value").alias("key"), F.col("body").alias("content"), F.lit("a，b").alias("tags"), F.lit(0.5).alias("confidence")))
    results = c.select(F.col("id").alias("chunk"), F.concat(F.lit('Here they are:\n```json\n{"cards": ['), obj, F.lit("]}\n```")).alias("text"))
    loose = A.extracted(results).withColumn("id", F.col("chunk"))
    good, bad = I.read_results(loose, "2024-03-01")
    return good.select("id", F.lit(True).alias("kept")).unionByName(bad.select("id", F.lit(False).alias("kept")))


@query(" SELECT id, CASE WHEN num % 4 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN num % 4 = 0 THEN coalesce(valid_to, DATE '2024-06-01') ELSE valid_to END AS valid_to FROM claims")
def l9_archived(spark, sf_dir):
    c = claims(spark, sf_dir)
    return U.archived(c, c.where("num % 4 = 0").select("id"), EXPIRY_REF).select("id", "status", "valid_to")


@query(" SELECT id, last, steps, false AS cyclic FROM (SELECT id, first_value(id) OVER w AS last, row_number() OVER w - 1 AS steps FROM claims WINDOW w AS (PARTITION BY slot ORDER BY valid_from DESC, num DESC)) WHERE steps > 0")
def l10_chains(spark, sf_dir):
    w = W.partitionBy("slot").orderBy(F.desc("valid_from"), F.desc("num"))
    return U.chains(claims(spark, sf_dir).withColumn("superseded_by", F.lag("id").over(w)))


@query(", a AS (SELECT *, count(*) OVER () AS total FROM claims WHERE status = 'active'), r AS (SELECT id, slot, total, row_number() OVER (PARTITION BY slot ORDER BY sha1('7|' || id), id) AS r FROM a), z AS (SELECT *, row_number() OVER (ORDER BY r > 1, sha1('7|' || id), id) AS z FROM r) SELECT id, slot FROM z WHERE z <= ceil(total * 0.05)")
def p1_planned(spark, sf_dir):
    return U.planned(claims(spark, sf_dir), "slot", ratio=0.05, seed=7).rows.select("id", "slot")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY importance DESC, hits DESC, num)::INTEGER AS ord, count(*) OVER (PARTITION BY subject) AS cards FROM claims WHERE status = 'active') SELECT subject, cards, ord, '  - `' || id || '` ' || title AS line FROM r WHERE ord <= 5 UNION ALL SELECT subject, cards, 0, '- **' || subject || '** (' || CAST(cards AS VARCHAR) || ')' FROM r WHERE ord = 1")
def sk4_brief(spark, sf_dir):
    return U.brief_lines(claims(spark, sf_dir))


TERMS = "click k1 42"
HAY_SQL = "lower(concat_ws(' ', title, value, subject, predicate, array_to_string(tags, ' '), body))"


@query(f", s AS (SELECT id, num, " + " + ".join(f"contains({HAY_SQL}, '{t}')::INTEGER" for t in TERMS.split()) + f" + 2 * contains({HAY_SQL}, '{TERMS}')::INTEGER + importance * 0.5::DOUBLE AS score FROM claims WHERE status = 'active') SELECT id, score FROM s WHERE score > 0 ORDER BY s.score DESC, num LIMIT 10")
def t11_terms(spark, sf_dir):
    return C.term_search(claims(spark, sf_dir), TERMS).select("id", "score")
