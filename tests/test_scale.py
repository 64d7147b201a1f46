"""What must hold where one source, slot or query is large: blocks, prefixes and rounds against plain models."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import cards, model_similarity

from slotwise.functions import text as T
from slotwise.operators import cards as C
from slotwise.operators import ordered as O
from slotwise.operators import records as R
from slotwise.operators import search as Q
from slotwise.sources import blocks as B
from slotwise.sources import table as TB
from slotwise.sources.claims import REF_TS, claims
from slotwise.streaming import stream as ST


def model_fit(costs, alone, budget, most):
    """Chunk numbers of records one after another."""
    out, chunk, used, n, shut = [], 0, 0, 0, False
    for cost, by_itself in zip(costs, alone, strict=True):
        if n and (used + cost > budget or n >= most or by_itself or shut):
            chunk, used, n = chunk + 1, 0, 0
        used, n, shut = used + cost, n + 1, by_itself
        out.append(chunk)
    return out


@pytest.fixture(scope="module")
def many_records(spark):
    rng = random.Random(1)
    sizes = (("a", 400), ("b", 3), (None, 60), ("c", 1), ("d", 700))
    rows = [(src, i, "file-meta" if rng.random() < 0.03 else "x", rng.randrange(0, 90)) for src, n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "source string, seq int, kind string, chars int")
    return df.withColumn("text", F.repeat(F.lit("a"), F.col("chars")))


@pytest.mark.parametrize(("block", "fan", "budget", "most"), [(R.BLOCK, O.FAN, 100, 5), (40, 2, 100, 5), (7, 3, 64, 3), (300, 2, 100, 40)])
def test_packing_by_blocks(many_records, monkeypatch, block, fan, budget, most):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(O, "FAN", fan)
    got = {(r["source"], r["seq"], r["part"]): r["chunk"] for r in R.packed(many_records, budget, most).collect()}
    cut = R.sliced(many_records, budget).collect()
    assert len(got) == len(cut)
    for src in ("a", "b", None, "c", "d"):
        own = sorted((r["seq"], r["part"], r["chars"], r["kind"]) for r in cut if r["source"] == src)
        want = model_fit([c + 2 for _, _, c, _ in own], [k == "file-meta" or k.endswith("-part") for *_, k in own], budget, most)
        assert [got[src, seq, part] for seq, part, _, _ in own] == want


def test_landings_by_doubling():
    rng = np.random.default_rng(4)
    cost, alone = rng.integers(2, 60, 500), rng.random(500) < 0.05
    after = R.successors(cost, alone, np.arange(500) == 0, 100, 7)
    at, n = R.landings(after, 450)
    for i in range(0, 450, 7):
        j, k = i, 0
        while j < 450:
            j, k = int(after[j]), k + 1
        assert (at[i], n[i]) == (j, k)


def test_packing_gathers_no_source(spark, many_records):
    plan = R.packed(many_records)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


@pytest.fixture(scope="module")
def claims_of_a_slot():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(60)]
    values = []
    for _ in range(110):
        base = " ".join(rng.choices(words, k=rng.randint(3, 8)))
        values.append(base)
        if rng.random() < 0.6:
            i = rng.randrange(len(base))
            values.append(base[:i] + rng.choice("xyz") + base[i + 1 :])
        if rng.random() < 0.2:
            values.append(values[rng.randrange(len(values))] + " q")
    rng.shuffle(values)
    return values + values[:6]


def test_first_wins_in_rounds(spark, claims_of_a_slot, monkeypatch):
    kept, want, digests = [], {}, {}
    for i, v in enumerate(claims_of_a_slot):
        near = next((k for k, x in kept if model_similarity(v, x) >= C.NEAR), None)
        if v in digests:
            want[i] = ("exact", digests[v])
        elif near is not None:
            want[i] = ("near", near)
        else:
            want[i], digests[v] = (None, None), i
            kept.append((i, v))
    monkeypatch.setattr(C, "FEW", 20)
    got = {int(r["id"][4:]): (r["reason"], r["into"] and int(r["into"][4:])) for r in C.deduplicated(cards(spark, claims_of_a_slot)).collect()}
    assert got == want and {x for x, _ in want.values()} == {None, "exact", "near"}


def test_pairs_of_a_slot_by_prefixes(spark, claims_of_a_slot, monkeypatch):
    monkeypatch.setattr(C, "FEW", 20)
    v = claims_of_a_slot
    assert len(set(v)) > C.FEW
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if model_similarity(v[i], v[j]) >= C.NEAR}
    assert {(int(r["a"][4:]), int(r["b"][4:])) for r in C.near_pairs(cards(spark, v)).collect()} == want
    different = list(dict.fromkeys(v))
    (best,) = C.slot_similarity(cards(spark, different)).collect()
    assert best["sim"] == pytest.approx(max(model_similarity(x, y) for x, y in itertools.combinations(different, 2)))


@pytest.mark.parametrize("least", [0.88, 0.7, 0.4])
def test_no_similar_pair_is_passed_over(spark, claims_of_a_slot, least):
    values = list(dict.fromkeys(claims_of_a_slot))[:90]
    df = spark.createDataFrame([("s", v) for v in values], "slot string, value string").select("slot", T.comparable(F.col("value")).alias("v")).distinct().withColumn("g", T.bigrams(F.col("v")))
    plain = [r["v"] for r in df.collect()]
    got = {(r["va"], r["vb"]) for r in C._found_pairs(df, least).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(plain, 2) if model_similarity(*p) >= least}


def test_few_candidates_of_a_large_slot(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(60)]
    n = 3000
    values = [" ".join(rng.choices(words, k=rng.randint(3, 8))) + " " + "".join(rng.choices("klmnopqrstuvwxyz", k=6)) for _ in range(n)]
    df = spark.createDataFrame([("s", v) for v in values], "slot string, value string").select("slot", T.comparable(F.col("value")).alias("v")).withColumn("g", T.bigrams(F.col("v")))
    p = C.prefixes(df, C.NEAR)
    assert C.candidates(p, p, C.NEAR, ordered=True).count() < 0.05 * n * (n - 1) / 2


# --- files in blocks ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def large_files(tmp_path_factory):
    """A log of several blocks with records that cross them, a file without any mark, one of blanks, one empty."""
    at = tmp_path_factory.mktemp("large")
    rng = random.Random(8)
    rows = ["before it all", ""]
    for i in range(120):
        rows.append(rng.choice(["[2024-01-05 10:00:{:02d}] first {}", " 2024/01/05 day {1}", "10:00:{:02d} time {}"]).format(i % 60, i))
        rows += [rng.choice(["  goes on", "", "and on \u00fc\u4e2d", "\tlast\r"]) for _ in range(rng.randrange(0, 6))]
    files = {"a.log": "\n".join([*rows, "end"]), "b.log": "\n".join(f"plain {i}" for i in range(90)), "c.log": "\n \n\t", "d.log": ""}
    for name, text in files.items():
        (at / name).write_bytes(text.encode())
    return at, files


def in_blocks(spark, path):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        return B.lines(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_files_in_blocks_like_whole_texts(spark, large_files):
    at, files = large_files
    ls = in_blocks(spark, at)
    assert ls.where("source like '%a.log'").select("_block").distinct().count() >= 4
    whole = spark.createDataFrame(list(files.items()), "source string, text string")
    name = F.element_at(F.split("source", "/"), -1).alias("source")
    got = sorted(tuple(r) for r in ls.select(name, "line", "text").collect())
    assert got == sorted((f, i, t.removesuffix("\r")) for f, text in files.items() for i, t in enumerate(text.split("\n")) if text)
    rows = lambda df, *cols: sorted(map(tuple, df.select(name, "seq", *cols, "text", "chars").collect()))
    assert rows(B.by_lines(ls), "kind") == rows(R.by_lines(whole), "kind")
    assert rows(B.islands(ls, "log"), "section", "locator") == rows(R.log_lines(whole), "section", "locator")


# --- a table that is kept up ---------------------------------------------------------------------

def test_updates_rewrite_few_groups(spark, sf):
    name = "cards_kept_up"
    c = claims(spark, sf)
    n = F.col("num")
    TB.build(c.where(n % 9 > 0).unionByName(c.where(n % 100 == 2).withColumns({"id": F.concat(F.lit("x"), "id"), "slot": F.lit("lone::slot")})), name, 8, 4)
    try:
        some = c.where("slot = 'team:all::reply_style'").withColumn("value", F.lit("new"))
        at = TB.update(spark, name, some, spark.table(name).where("slot = 'lone::slot'").select("id"), 8, 4)
        assert 1 <= len(at) <= 2
        want = c.where((n % 9 > 0) & (F.col("slot") != "team:all::reply_style")).unionByName(some)
        key = lambda df: sorted((r["id"], r["slot"], r["value"]) for r in df.select("id", "slot", "value").collect())
        assert key(TB.table(spark, name)) == key(want)
        assert TB.update(spark, name, c.limit(0), None, 8, 4) == []
        # the last card of a group goes
        left = TB.table(spark, name)
        TB.update(spark, name, c.limit(0), left.select("id"), 8, 4)
        assert TB.table(spark, name).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_slots_of_a_table_need_no_shuffle(spark, sf):
    name = "cards_by_bucket"
    TB.build(claims(spark, sf), name, 2, 4)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        t = TB.table(spark, name)
        plan = C.conflicts(t).join(t.select("slot", "id"), "slot")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- searches of many queries ----------------------------------------------------------------------

def test_many_queries_like_one_by_one(spark, sf):
    c = claims(spark, sf)
    asked = ["click by 42 on k1 card, reply-style of team all", "ERROR", "", "k=7 number 3", "用户 view_d20240101"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(99, None)], "qid int, query string")
    got = {}
    for r in Q.search_many(c, df, REF_TS, 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    for i, q in enumerate(asked):
        one = C.search(c, q, REF_TS, 5).collect() if q else []
        assert sorted(got.get(i, [])) == [(k + 1, r["id"], round(r["score"], 9)) for k, r in enumerate(one)]
    assert 99 not in got


# --- streams ---------------------------------------------------------------------------------------

def test_expirations_go_on_after_a_restart(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def run(number, rows):
        (src / f"{number}.json").write_text("\n".join(f'{{"id": "{i}", "recorded_at": "{a}", "expires_at": {e}}}' for i, a, e in rows))
        with ST.timed_state(spark):
            log = ST.audit_stream(spark, str(src), "id string, recorded_at timestamp, expires_at timestamp")
            q = ST.expirations(log).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
        return sorted((r["id"], str(r["expires_at"])) for r in spark.read.schema("id string, expires_at timestamp").parquet(out).collect())

    assert run(1, [("a", "2024-01-01T00:00:00", '"2024-01-02T00:00:00"'), ("b", "2024-01-01T00:00:00", '"2024-01-02T00:00:00"'), ("c", "2024-01-01T00:00:00", "null")]) == []
    # news of b move its end; what ended by the new event time goes
    assert run(2, [("b", "2024-01-01T12:00:00", '"2024-01-09T00:00:00"'), ("d", "2024-01-03T00:00:00", '"2024-01-04T00:00:00"')]) == [("a", "2024-01-02 00:00:00")]
    assert run(3, [("e", "2024-02-01T00:00:00", "null")]) == [("a", "2024-01-02 00:00:00"), ("b", "2024-01-09 00:00:00"), ("d", "2024-01-04 00:00:00")]


def test_truth_changes_card_by_card(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    steps = [[("1", 1, "s", "active", "2024-01-01", 1), ("2", 2, "s", "active", "2024-01-02", 1), ("3", 3, "t", "active", "2024-01-01", 1)], [("2", 2, "s", "disputed", "2024-01-02", 2)], [("2", 2, "s", "active", "2024-01-02", 1), ("1", 1, "s", "superseded", "2024-01-01", 3)]]
    schema, seen = "id string, num long, slot string, status string, since timestamp, version long", []
    for k, rows in enumerate(steps):
        names = ("id", "num", "slot", "status", "since", "version")
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))

        def keep(batch, number):
            seen.extend((r["slot"], r["current"], r["members"], r["needs_human"]) for r in batch.collect())

        with ST.timed_state(spark):
            q = ST.truth_changes(ST.audit_stream(spark, str(src), schema)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
    assert sorted(seen[:2], key=str) == [("s", "2", "2,1", False), ("t", None, None, None)] and seen[2:] == [("s", "2", "2,1", True), ("s", None, None, None)]


def _searched(spark, n=3000, asked=400):
    """Cards and queries that share frequent words, a subject for many and rare ones for some."""
    c = spark.range(n).select(
        F.format_string("mem_%05d", "id").alias("id"), (n - F.col("id")).alias("num"), F.lit("all things").alias("title"), F.concat(F.lit("word"), F.col("id") % 40).alias("value"), F.concat(F.lit("text of "), F.col("id") % 700).alias("body"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("often"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.array(F.concat(F.lit("name "), F.col("id") % 5)).alias("aliases"),
        F.when(F.col("id") % 30 == 0, "team:all").otherwise(F.concat(F.lit("u:"), F.col("id") % 90)).alias("subject"), F.concat(F.lit("p_"), F.col("id") % 2).alias("predicate"), F.lit("active").alias("status"),
        (F.lit(0.5) + (F.col("id") % 7) * 1e-12).alias("confidence"), ((F.col("id") % 13) / 13).alias("importance"), F.lit("2024-01-01").cast("timestamp").alias("recorded_at"), F.lit("2024-01-01").cast("date").alias("valid_from"), (F.col("id") % 2).cast("int").alias("hits"))
    c = c.withColumn("slot", T.slot(F.col("subject"), F.col("predicate")))
    q = spark.range(asked).select(F.col("id").alias("qid"), F.concat(F.lit("things of team:all, often name "), F.col("id") % 9, F.lit(" word"), F.col("id") % 50).alias("query"))
    return c, q


def test_frequent_keys_of_many_queries(spark):
    c, q = _searched(spark)
    c, q = c.localCheckpoint(), q.localCheckpoint()
    index = Q.inverted(c).localCheckpoint()
    asked = Q.query_keys(q, {"last": [1, 2, 3], "predicate": [2], "tag": [5], "aliases": [6]}).localCheckpoint()
    common, _ = Q._common(index, asked, q)
    # what is left to meet by keys is less than what the keys are
    rare = index.join(asked.join(common, ["kind", "key"], "left_anti"), ["kind", "key"]).where("kind <> 'aliases'")
    assert rare.count() < index.count() * 2 < index.join(asked, ["kind", "key"]).count() / 5
    got = {(r["qid"], r["rank"]): r["id"] for r in Q.search_many(c, q, REF_TS, index=index).collect()}
    assert len(got) == 400 * 8
    for qid in (0, 3, 44, 399):
        text = q.where(F.col("qid") == qid).first()["query"]
        # scores that agree to nine places are ties, which the smaller number wins
        want = C.search(c, text, REF_TS, limit=3000).orderBy(F.desc(F.round("score", 9)), "num").limit(8).collect()
        assert [got[qid, i + 1] for i in range(8)] == [r["id"] for r in want]


def test_stretches_of_many_queries_are_not_broadcast(spark, monkeypatch):
    """What is cut out of a small file of queries looks small to Spark, and all of it went through the driver."""
    c, q = _searched(spark, 600, 40)
    plans = []
    kept = Q.kept_apart
    monkeypatch.setattr(Q, "kept_apart", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    Q.search_many(c, q, REF_TS).collect()
    lines = [line for p in plans for line in p.splitlines()]
    assert any("SortMergeJoin [kind" in line and line.endswith("Inner") for line in lines)


def test_names_whose_tokens_are_met_do_not_meet_again(spark):
    asked = spark.createDataFrame([(1, "token", "error"), (1, "alias_token", "error"), (1, "aliases", "error card"), (1, "aliases", "rror"), (2, "aliases", "error card")], "qid int, kind string, key string")
    assert {tuple(r) for r in Q._telling(asked).collect()} == {(1, "token", "error"), (1, "alias_token", "error"), (1, "aliases", "rror"), (2, "aliases", "error card")}


def test_what_many_queries_name_is_put_together_once(spark):
    c, q = _searched(spark, 600, 40)
    c = c.withColumn("status", F.when(F.col("num") % 5 == 0, "disputed").when(F.col("num") % 7 == 0, "expired").otherwise("active"))
    q = q.withColumn("query", F.when(F.col("qid") % 4 == 0, "u:7, U:8 and u:none").when(F.col("qid") % 4 == 1, "u:none name 3").otherwise(F.col("query")))
    found = Q.search_many(c, q, REF_TS)
    named = Q.same_slot(c, q)
    plain = C.truth_table(c.join(named.unionByName(found.join(named.select("qid").distinct(), "qid", "left_anti").select("qid", "id")), "id"), "qid")
    assert sorted(Q.contested(c, q, found).collect()) == sorted(plain.collect())


def _streamed(spark, at, df, stream):
    """Rows that a stream over a folder gives in one run, and the values that its state holds."""
    df.write.json(f"{at}/in", timestampFormat="yyyy-MM-dd'T'HH:mm:ss")
    rows = []
    with ST.timed_state(spark):
        q = stream(ST.audit_stream(spark, f"{at}/in", df.schema)).writeStream.outputMode("update").foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return rows, max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)


def test_state_of_expirations_is_a_few_values(spark, tmp_path):
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 50 * 3600 + n * 86400)
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), day(F.lit(0)).alias("recorded_at"), F.when(F.col("id") % 7 > 0, day(F.col("id") % 3)).alias("expires_at"))
    rows, held = _streamed(spark, tmp_path, df, lambda s: ST.expirations(s).select("id", F.date_format("expires_at", "yyyy-MM-dd HH").alias("at")))
    end = 1704067200 + 49 * 3600
    want = {(r["id"], r["at"]) for r in df.where(F.unix_timestamp("expires_at") < end).select("id", F.date_format("expires_at", "yyyy-MM-dd HH").alias("at")).collect()}
    assert want <= {tuple(r) for r in rows} and len(rows) == len(set(rows)) and held <= 3 * ST.BUCKETS


def test_state_of_truth_changes_is_a_few_values(spark, tmp_path):
    i = F.col("id")
    df = spark.range(4000).select(i.cast("string").alias("id"), i.alias("num"), F.concat(F.lit("s"), i % 1500).alias("slot"), F.when(i % 4 == 0, "expired").otherwise("active").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("since"), F.lit(1).cast("long").alias("version"))
    rows, held = _streamed(spark, tmp_path, df, ST.truth_changes)
    assert len(rows) == 1500 and held <= ST.BUCKETS
    got = {r["slot"]: r["members"] for r in rows}
    assert got["s1"] == "3001,1501,1" and got["s0"] is None and got["s2"] == "3002,1502,2" and got["s1000"] is None and got["s1002"] == "2502,1002" and got["s1001"] == "2501,1001"


def test_cards_of_one_named_subject_are_dealt(spark):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    c = spark.createDataFrame([(f"m{i}", "team:all" if i else "Team:ALL") for i in range(5000)] + [("x", "user:1"), ("y", None)], "id string, subject string")
    asked = [(i, "who is team:all, team:all?") for i in range(1500)] + [(None, "team:all"), (7, "user:1"), (8, "user:2")]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = Q.same_slot(c, spark.createDataFrame(asked, "qid long, query string"))
        assert found.columns == ["qid", "id"]
        assert found.distinct().count() == found.count() == 1501 * 5000 + 1
        assert {(r["qid"], r["id"]) for r in found.where("id in ('x', 'y') or id = 'm0' and (qid is null or qid < 2)").collect()} == {(7, "x"), (None, "m0"), (0, "m0"), (1, "m0")}
        in_tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert max(in_tasks) < 0.7 * 1501 * 5000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
