from __future__ import annotations

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators import nested as N
from slotwise.operators import records as R
from slotwise.operators import upkeep as U
from slotwise.sources import cards as S
from slotwise.sources import sinks
from slotwise.sources.cards import ReadOnly
from slotwise.sources.claims import claims
from slotwise.streaming import stream


@pytest.mark.parametrize(("value", "path", "want"), [
    ({"content": "x"}, "content", "x"), ({"content": [{"text": "a"}]}, "content[].text", "a"), ({"content": [{"text": "a"}, {"text": "b"}]}, "content[].text", "a\nb"),
    ({"c": ["a", "b"]}, "c", "a\nb"), ({"meta": {"k": 1}}, "meta.k", "1"), ({"a": 1}, "b", None), ({"a": ""}, "a", None), ({"c": [{"x": 1}]}, "c[].text", '{"x":1}'), ("s", "a", None), ({"a": {"b": 1}}, "a", '{"b":1}')])
def test_path_lookup(value, path, want):
    assert N.picked(value, path) == want


def test_json_walk():
    value = {"items": [{"title": "t", "content": [{"text": "deep"}], "n": 3}, "loose"], "n": 1, "m": None}
    # one string among three fields is too few for a record, so its parts are
    assert list(N.walked(value, "f")) == [("json-string", "f.items[0].title", "t"), ("json-object", "f.items[0].content[0]", "text: deep"), ("json-string", "f.items[1]", "loose")]
    got = list(N.walked([{"title": "t", "body": "b", "content": [{"text": "deep"}], "n": 3}], "f"))
    assert got == [("json-object", "f[0]", "title: t\nbody: b\ncontent.text: deep\ncontent: [1 items]\nn: 3")]


def texts(spark, *rows, columns="source string, text string"):
    return spark.createDataFrame(list(rows), columns)


def test_json_lines_and_bad_ones(spark):
    bad = "\n".join(['{"a": "x"}', *["{"] * 5, '{"n": 1}'])
    got = R.json_lines(texts(spark, ("s", bad), ("e", ""), ("n", None))).orderBy("seq").collect()
    assert [r["kind"] for r in got] == ["jsonl-line", *["jsonl-invalid"] * 3, "jsonl-line", "meta-note"]
    assert got[4]["text"] == '{"n":1}'


def test_recipes(spark):
    rows = [("a", '[{"role": "u", "content": "c"}, 5]', "json_array"), ("b", '{"role": "u", "content": [{"text": "x"}]}\nbad', "jsonl"), ("c", "?", "whole"), ("d", "[", "json_array"), ("e", "k,v\n1,2", "csv"), ("f", "hi\nUser: a", "conversation")]
    df = texts(spark, *rows, columns="source string, text string, strategy string")
    got = {s: [r["text"] for r in sorted(R.by_recipe(df).collect(), key=lambda r: r["seq"]) if r["source"] == s] for s, _, _ in rows}
    assert got == {"a": ["角色: u\n内容: c", "5"], "b": ["角色: u\n内容: x", "bad"], "c": [], "d": [], "e": ["k: 1\nv: 2"], "f": ["(未标注):\nhi", "User::\na"]}
    said = {(r["source"], r["warning"]) for r in R.recipe_warnings(df.withColumn("strategy", F.when(F.col("source") == "e", "magic").otherwise(F.col("strategy")))).collect()}
    assert said == {("c", "noise_dropped"), ("d", "noise_dropped"), ("e", "unknown_strategy")}


def test_rules_put_a_header_first_and_keep_it_alone(spark):
    df = texts(spark, ("a", "one\n\ntwo", "text"), ("b", "[broken", "json"), ("c", "", "text"), ("d", "[]", "json"), columns="source string, text string, format string")
    got = R.by_rules(df)
    kinds = {s: [r["kind"] for r in sorted(got.collect(), key=lambda r: r["seq"]) if r["source"] == s] for s in "abcd"}
    assert kinds == {"a": ["file-meta", "text", "text"], "b": ["file-meta", "parse-error"], "c": ["file-meta"], "d": ["file-meta", "text-whole"]}
    assert [r["record_count"] for r in R.chunks(got.where("source = 'a'")).orderBy("chunk").collect()] == [1, 2]


def test_rules_read_a_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [("a", "one\n\ntwo"), ("b", " " * 5000 + "x"), ("c", ""), (None, "three"), ("d", None), ("e", "\u3000"), ("e", "four")]
    df = texts(spark, *rows, columns="source string, text string").select("source", counted("text").alias("text"), F.lit("text").alias("format"))
    got = R.by_rules(df)
    R.chunks(got).collect()
    assert seen.value == len(rows)
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 3, "b": 2, "c": 1, None: 2, "d": 1, "e": 3}


def test_long_blocks_are_refilled(spark):
    text = "A sentence. " * 1000
    got = R.by_sentences(texts(spark, ("s", text))).collect()
    assert len(got) == 4 and all(r["chars"] <= 4000 for r in got)


@pytest.mark.parametrize(("budget", "most", "n"), [(2000, 40, 10), (2000, 0, 10), (float("nan"), 40, 3), (0, None, 3)])
def test_limits(spark, budget, most, n):
    df = spark.range(30).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("seq"), F.lit("x").alias("kind"), F.repeat(F.lit("a"), F.lit(500)).alias("text"), F.lit(500).alias("chars"))
    assert R.chunks(df, budget, most).count() == n


CARD = "id string, num long, slot string, type string, status string, value string, body string, recorded_at timestamp, valid_from date, valid_to date"


def card(spark, *rows):
    return spark.createDataFrame([(i, n, s, t, "active", v, b, None, None, None) for i, n, s, t, v, b in rows], CARD)


def test_decisions(spark):
    c = card(spark, ("1", 1, "m", "t", "v", "long body"), ("2", 2, "m", "t", "w", ""), ("3", 3, "d", "t", "v", ""), ("4", 4, "x", "t", "v", ""), ("5", 5, "k", "t", "v", "b"), ("6", 6, "k", "t", "v", "b"), ("7", 7, "o", "t", None, None), ("8", 8, "d", "t", "v", ""), ("9", 9, "x", "t", "v", ""), ("10", 10, "l", "t", "v", "lone"))
    # a slot of one card has no conflict to decide
    d = spark.createDataFrame([("m", "merge"), ("d", "dispute"), ("x", "drop"), ("k", "keep-first"), ("l", "drop"), ("o", "supersede")], "slot string, action string")
    got = {r["id"]: (r["status"], r["body"]) for r in U.decided(c, d).collect()}
    assert got == {"1": ("active", "long body\n\nw\n\n> merged 1 cards of this slot"), "3": ("disputed", ""), "8": ("disputed", ""), "5": ("active", "b"), "7": ("active", None), "10": ("active", "lone")}


def test_chains_end_or_are_cycles(spark):
    rows = [(str(i), str(i + 1)) for i in range(9)] + [("9", None), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r["id"]: (r["last"], r["cyclic"]) for r in U.chains(spark.createDataFrame(rows, "id string, superseded_by string")).collect()}
    assert all(got[str(i)] == ("9", False) for i in range(9)) and got["z"] == ("gone", False) and got["x"][1] and got["y"][1]
    assert U.chains(spark.createDataFrame([], "id string, superseded_by string")).count() == 0


@pytest.mark.parametrize(("ask", "want"), [
    ({"count": 9999}, (15, None, ["SAMPLE_CLAMPED"])), ({"ratio": 0.001}, (1, None, [])), ({"ratio": 0.2}, (3, None, [])), ({"count": 3, "ratio": 0.5}, (8, None, [])), ({"count": 3.7}, (3, None, [])),
    ({"count": 0}, (0, "NO_SAMPLE", [])), ({"count": "abc"}, (0, "BAD_COUNT", [])), ({"ratio": 2}, (0, "BAD_RATIO", [])), ({"ratio": 0}, (0, "BAD_RATIO", [])), ({"seed": "xyz"}, (0, "BAD_SEED", [])),
    ({"strategy": "odd"}, (0, "BAD_STRATEGY", [])), ({"scope": "odd"}, (0, "BAD_SCOPE", [])), ({"strategy": "stratified", "count": 2}, (2, None, ["SAMPLE_COVERAGE"])), ({"strategy": "slot", "count": 12}, (12, None, []))])
def test_sampling_plans(spark, ask, want):
    kinds = ["preference"] * 6 + ["environment"] * 4 + ["lesson"] * 3 + ["project"] * 2
    slots = [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    c = card(spark, *[(f"{i:02}", i, f"s{s}", k, "v", "b") for i, (k, s) in enumerate(zip(kinds, slots, strict=True))])
    p = U.planned(c, **ask)
    assert (p.target, p.code, p.warnings) == want
    if p.rows is not None:
        assert p.rows.count() == p.target and (ask.get("strategy") != "slot" or p.rows.select("slot").distinct().count() == 12)


def test_published_generator():
    assert U.draws(42, 5).tolist() == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693, 0.17481389874592423]
    assert sorted(U.shuffled(list(range(20)), 7)) == list(range(20)) and U.shuffled([], 1) == []


def test_sinks(spark, sf, tmp_path):
    c = claims(spark, sf).where("num <= 50")
    sinks.write_card_files(c, str(tmp_path / "cards"))
    back = S.parsed_cards(sinks.read_card_files(spark, str(tmp_path / "cards")))
    assert back.join(c, ["id", "subject", "predicate", "value", "tags"], "left_semi").count() == 50
    for write in (lambda: sinks.write_card_files(c, "x", "trial"), lambda: sinks.write_brief(c, "x", mode="trial"), lambda: sinks.snapshot(c, "x", "s", "trial")):
        with pytest.raises(ReadOnly):
            write()
    sinks.write_brief(c, str(tmp_path / "brief"))
    assert spark.read.text(str(tmp_path / "brief")).count() == U.brief_lines(c).count()
    m = sinks.write_task(texts(spark, ("a b.md", "# x\ny", "markdown"), columns="source string, text string, format string"), str(tmp_path / "task"))
    assert [r["chunk"] for r in m.orderBy("chunk").collect()] == ["a-b-md-0000", "a-b-md-0001"]


def test_block_lists_and_import(spark):
    text = "---\nid: mem_00001\ntype: lesson\ntags:\n  - a\n  - \"b c\"\naliases: [x, y]\n---\nbody"
    r = S.parsed_cards(texts(spark, ("c/m.md", text), columns="path string, text string")).first()
    assert (r["tags"], r["aliases"], r["body"]) == (["a", "b c"], ["x", "y"], "body")
    got = sinks.imported(texts(spark, ("n/My Note.md", "\n# Head\nx"), ("n/b.md", "plain"), ("n/c.md", " "), columns="path string, text string"), "2024-01-01").orderBy("title").collect()
    assert [(r["title"], r["subject"]) for r in got] == [("Head", "import:my-note"), ("b", "import:b")]


def test_streaming_expiry(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda n, *rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "recorded_at": at}) for i, at in rows))
    put(1, ("a", "2024-01-01T00:00:00Z"))
    s = stream.audit_stream(spark, str(tmp_path / "in"), "id string, recorded_at timestamp")
    q = stream.expiring(s, "1 day").writeStream.outputMode("append").format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        put(2, ("b", "2024-02-01T00:00:00Z"))
        q.processAllAvailable()
        put(3, ("b", "2024-02-02T00:00:00Z"))
        end = time.time() + 60
        while time.time() < end and not (got := spark.sql("SELECT id FROM gone WHERE event = 'expired'").collect()):
            q.processAllAvailable()
        assert [r["id"] for r in got] == ["a"]
    finally:
        q.stop()


def test_map_notes_name_ids_of_any_length(spark):
    c = spark.createDataFrame([("mem_00001", "active"), ("mem_123456", "active"), ("mem_100000", "expired")], "id string, status string")
    maps = spark.createDataFrame([("m", "see mem_00001, mem_100000, mem_123456, mem_1234567 and mem_1234")], "map string, text string")
    assert {tuple(r) for r in U.stale_maps(maps, c).collect()} == {("m", "mem_100000"), ("m", "mem_1234567")}


def test_sweep_finds_long_ids_in_map_notes(spark, sf):
    c = claims(spark, sf).limit(0).unionByName(claims(spark, sf).where("num = 8").withColumn("id", F.lit("mem_100000")))
    maps = c.select(F.lit("all").alias("map"), F.concat(F.lit("see "), "id").alias("text"))
    assert U.sweep(c, "2024-06-01", maps).where("kind = 'stale_map'").select("id", "detail").collect() == [("mem_100000", "all")]


@pytest.mark.parametrize(("text", "want"), [
    ("One, two, three. Four\nand, so, on.", "text"), ("One; two; three.\nand; so; on.", "text"), ("a | b | c.\nd | e |", "text"), ("a, b, c\n1, 2, 3", "csv"),
    ("1,It works. Now,x\n2,No.,y", "csv"), ("a;b;c\n1.;2.;3.", "csv"), ("a\tb\tc\nOne. Two\tx\ty", "csv"), ("no., name, note\n1, x, y", "csv")])
def test_even_commas_of_sentences_make_no_table(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.sniffed(F.col("t"), F.lit("x"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("One,$$$ two&&& three,### four.***\nand,%%% so,*** on.", "text"), ("One goes on,xy two, three. Four\nand, so, on.", "text"), ("Un, dos,éé tres.&&&\ny, así, ya.", "text"),
    ("1,It works. Now, well,x\n2,No.,y,z", "csv"), ("1,--,So it is.\n2,--,No.", "csv"), ("a.,$$,b\n1,2,3", "csv"), ('"So. It, is",,\n"x, y",,', "csv")])
def test_words_with_marks_behind_them_make_no_table(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.sniffed(F.col("t"), F.lit("x"))).first()[0] == want


def test_json_records_are_handed_on_in_frames():
    class Texts:
        schema = {"source": type("S", (), {"dataType": type("D", (), {"simpleString": staticmethod(lambda: "string")})})}

        def mapInPandas(self, run, schema):
            return run

    row = "x" * 3000
    run = N._records(Texts(), lambda r: (("k", f"l{i}", row) for i in range(int(r.text))))
    frames = list(run([pd.DataFrame({"source": ["a", "b", "c"], "text": ["7000", None, "3"]}), pd.DataFrame({"source": ["d"], "text": ["2"]})]))
    assert max(map(len, frames)) <= N.MOST_CHARS // 3000 + 1 and sum(map(len, frames)) == 7005
    every = pd.concat(frames)
    assert list(every["pos"]) == [*range(7000), 0, 1, 2, 0, 1] and list(every["source"].unique()) == ["a", "c", "d"]


def test_only_values_asked_for_are_made_plain(spark):
    """Numbers are told by a pattern, once for each column, however many keys a card has."""
    df = spark.createDataFrame([("lesson/a.md", "---\nid: 007\ntitle: '1.50'\nhits: 2.0\nvalue: 01.50\nsubject: no\n---\nb")], "path string, text string")
    patterns = lambda *names: S.parsed_cards(df).select(*names)._jdf.queryExecution().optimizedPlan().toString().count(r"^-?\d+\.\d+$")
    assert 0 < patterns("id") and patterns("id", "title") == 2 * patterns("id") and patterns("body") == 0
    assert tuple(S.parsed_cards(df).select("id", "title", "value", "subject", "hits", "body", "problem").first()) == ("7", "1.50", "1.5", None, 2, "b", None)
