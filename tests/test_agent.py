from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slotwise.operators import agent as A
from slotwise.operators import intake as I
from slotwise.operators import upkeep as U


@pytest.mark.parametrize(("text", "want"), [
    ('{"cards": [{"title": "t"}]}', 1), ('```json\n[{"name": "t"}, {"name": "u"}]\n```', 2), ('Here: {"memories": [{"title": "x"}]} done', 1),
    ('{"card": {"title": "x"}}', 1), ('{"title": "x"}', 0), ('I saw {"foo": 1} there', 0), ('so {"cards": 1} and [{"title": "x"}]', 1), ("nothing", 0), (None, 0), ("[1, 2]", 0), ('{"a": [{"title": "x"}, {"title": "y"}]}', 2)])
def test_loose_results(text, want):
    assert len(A.cards_in(A.loose(text))) == want


def test_coercion(spark):
    df = spark.createDataFrame([("1", '[{"category": "lesson", "name": "n", "slot": "a::b", "tags": "x，y", "content": "c"}]'), ("2", "?")], "chunk string, text string")
    got = {r["chunk"]: r for r in A.extracted(df).collect()}
    r = got["1"]
    assert (r["type"], r["title"], r["subject"], r["predicate"], r["value"], r["tags"], r["body"]) == ("lesson", "n", "a", "b", "n", ["x", "y"], "c")
    assert got["2"]["error"] == "no_json"
    manifest = spark.createDataFrame([("1",), ("2",), ("3",)], "chunk string")
    assert {x["chunk"]: x["state"] for x in A.progress(manifest, A.extracted(df)).collect()} == {"1": "ok", "2": "error", "3": "missing"}


def test_recipes(spark):
    df = spark.createDataFrame([("a", "jsonl", {"t": "a[].$b"}), ("b", "jsonl", {"t": "a..b"}), ("c", "magic", None), ("d", "record_separator", None), ("e", "separator", None)], "id string, s string, f map<string,string>")
    assert {r["id"]: r["p"] for r in df.select("id", A.recipe_problem(F.col("s"), F.col("f")).alias("p")).collect()} == {"a": None, "b": "bad_path", "c": "unknown_strategy", "d": None, "e": "unknown_strategy"}


def test_fields_and_lists_of_loose_cards(spark):
    raw = '{"cards": [{"type": "Decision", "title": "t", "subject": "s", "predicate": "p", "value": 3, "aliases": ["a", " ", 1], "links": ["extends:x"], "confidence": "0.9", "importance": 2, "status": "odd", "valid_from": "2024-01-02"}, {"type": "\u504f\u597d", "slot": "a::b", "name": "n"}]}'
    got = A.extracted(spark.createDataFrame([("1", raw), ("2", "[]"), ("3", "no json")], "chunk string, text string")).orderBy("chunk", "ord").collect()
    assert (got[0]["type"], got[0]["value"], got[0]["aliases"], got[0]["links"], got[0]["confidence"], got[0]["importance"], got[0]["valid_from"]) == ("decision", "3", ["a", "1"], ["extends:x"], "0.9", "2", "2024-01-02")
    assert (got[1]["type"], got[1]["subject"], got[1]["predicate"], got[1]["value"]) == ("preference", "a", "b", "n")
    assert [r["error"] for r in got] == [None, None, "no_cards", "no_json"]
    many = '{"cards": [' + ",".join(['{"title": "t"}'] * 70) + "]}"
    df = spark.createDataFrame([("1", many)], "chunk string, text string")
    assert A.extracted(df).count() == 60 and A.of_chunks(df).count() == 40


def test_normalised_cards(spark):
    rows = [
        ("1", "lesson", "  t\u00a0", " my  subject\t", "a b", None, "x" * 1300, "odd", "7", "nan", "2024-1-1", None, [" a ", "", *map(str, range(20))], ["extends:x", "likes:y", "z"]),
        ("2", "memo", "t", "s", "p", "v", "", None, None, None, None, None, None, None), ("3", "lesson", "t", " ", "p", "v", "", None, None, None, None, None, None, None), ("4", "lesson", "", "s", "p", "", "b", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, type string, title string, subject string, predicate string, value string, body string, status string, confidence string, importance string, valid_from string, valid_to string, tags array<string>, links array<string>")
    (r,) = I.normalised(df, "2024-03-01").collect()
    assert (r["title"], r["subject"], r["predicate"], r["value"], r["status"], r["confidence"], r["importance"], str(r["valid_from"])) == ("t", "my-subject", "a_b", "t", "active", 1.0, 0.75, "2024-03-01")
    assert r["body"] == "x" * 1180 + "\n[内容超长已截断]" and r["tags"] == ["a", *map(str, range(11))] and r["links"] == ["extends:x"]
    good, bad = I.read_results(df, "2024-03-01")
    assert [x["id"] for x in good.collect()] == ["1"] and {x["id"] for x in bad.collect()} == {"2", "3", "4"}


def test_resolution(spark):
    def held(extra=()):
        rows = [("2", "s", "active", "lesson", " two ", ["b"], 2, "x"), ("1", "s", "disputed", "lesson", "one", ["a"], 1, "x"), ("3", "s", "expired", "lesson", "three", [], 5, "x"), ("4", "t", "active", "lesson", "four", [], 0, "x")]
        return spark.createDataFrame([*rows, *extra], "id string, slot string, status string, type string, body string, tags array<string>, hits int, source string").withColumn("valid_to", F.lit(None).cast("date"))

    def after(verdict, winner=None, note=None):
        d = spark.createDataFrame([("s", verdict, winner, note)], "slot string, verdict string, winner string, note string")
        return {r["id"]: r for r in U.resolved(held(), d, "2024-03-01 10:00:00").collect()}

    got = after("supersede", "2", "ok")
    assert [got[i]["status"] for i in "1234"] == ["superseded", "active", "expired", "active"] and got["1"]["superseded_by"] == "2" and str(got["1"]["valid_to"]) == "2024-03-01" and got["1"]["ended_at"] is not None
    assert got["2"]["body"] == " two \n\n> 裁决记录 2024-03-01: ok" and got["2"]["supersedes"] == ["1"]
    got = after("merge")  # the first card by id is the winner, and its state stays
    assert (got["1"]["body"], got["1"]["tags"], got["1"]["hits"], got["1"]["source"], got["1"]["status"]) == ("one\n\ntwo", ["a", "b"], 3, "x|merged:2", "disputed") and got["2"]["superseded_by"] == "1"
    got = after("keep", "2")
    assert (got["1"]["status"], got["1"]["superseded_by"], got["2"]["status"]) == ("superseded", None, "active")
    assert [after("dispute")[i]["status"] for i in "1234"] == ["disputed", "disputed", "expired", "active"]
    assert [after("archive")[i]["status"] for i in "1234"] == ["archived", "archived", "expired", "active"]
    assert [after("merge", "4")[i]["status"] for i in "1234"] == ["disputed", "active", "expired", "active"]
    d = spark.createDataFrame([("s", "merge", "4"), ("t", "guess", None), ("u", "keep", None)], "slot string, verdict string, winner string")
    assert {(r["slot"], r["error"]) for r in U.resolution_errors(held(), d).collect()} == {("s", "unknown_winner"), ("t", "unknown_verdict"), ("u", "no_members")}


def test_results_are_read_once(spark):
    rows = [(f"c{i}", "lesson" if i % 3 else "memo", f"t{i}", "s", "p", f"v{i}", "b" * (2000 if i % 5 == 0 else 5)) for i in range(60)] + [(None, "lesson", "t", "s", "p", "v", "b"), ("c1", "memo", "t", "s", "p", "v", "b")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    loose = spark.createDataFrame(rows, "id string, type string, title string, subject string, predicate string, value string, body string")
    good, bad = I.read_results(loose.mapInPandas(counted, loose.schema), "2024-03-01")
    got = [tuple(r) for r in good.selectExpr("id", "true").union(bad.selectExpr("id", "false")).collect()]
    # a card without an id is kept and told to be none, as before; one of the rows of c1 is a card
    want = [(f"c{i}", i % 3 > 0) for i in range(60)] + [(None, True), (None, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert seen.value == len(rows)
