"""Operators on small frames, against plain Python models."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions import temporal as D
from slotwise.functions import text as T
from slotwise.operators import cards as C
from slotwise.operators import records as R
from slotwise.sources import cards as S


def one(spark, column, **values):
    names = list(values)
    row = [tuple(values[n] for n in names)]
    return spark.createDataFrame(row, ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def model_similarity(a, b):
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    a, b = plain(a), plain(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    grams = lambda s: {s} if len(s) == 1 else {s[i : i + 2] for i in range(len(s) - 1)}
    x, y = grams(a), grams(b)
    both = len(x & y)
    return min(1.0, (0.35 * 2 * both / (len(x) + len(y)) + 0.65 * both / min(len(x), len(y))) * (0.85 + 0.15 * min(len(a), len(b)) / max(len(a), len(b))))


def test_similarity_like_its_model(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abcd结论 ,", k=rng.randint(0, 12))), "".join(rng.choices("abcd结论 ,", k=rng.randint(0, 12)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r["s"] == pytest.approx(model_similarity(r["a"], r["b"])), r


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, T.tokens(F.col("t")), t="使用 Spark_3 测") == ["使用", "测", "spark_3"]


def test_fnv_reference_value(spark):
    assert one(spark, T.fnv1a(F.col("t")), t="a") == "e40c292c"


def test_slug(spark):
    assert one(spark, T.slug(F.col("t")), t="  Hello, World! ") == "hello-world"
    assert len(one(spark, T.slug(F.col("t")), t="结论")) == 8


def test_dates(spark):
    today = F.lit("2024-03-01").cast("date")
    assert one(spark, D.normalized_date(F.col("t"), today), t="yesterday") == "2024-02-29"
    assert one(spark, D.normalized_date(F.col("t"), today), t="soon") == "soon"
    assert one(spark, D.parsed(F.col("t")), t="2024-01-02T03:04Z") == dt.datetime(2024, 1, 2, 3, 4)


CARDS = "num long, id string, slot string, value string, body string, digest string, source string, status string, subject string, predicate string, title string, valid_from date, recorded_at timestamp"


def cards(spark, values):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, f"mem_{i:05d}", "s::p", v, "b", v, "src", "active", "s", "p", "t", None, at + dt.timedelta(hours=i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, CARDS)


def test_dedupe_keeps_the_first(spark):
    got = {r["id"]: (r["reason"], r["into"]) for r in C.deduplicated(cards(spark, ["conclusion first", "conclusion first", "conclusion first!", "other"])).collect()}
    assert got["mem_00000"] == (None, None)
    assert got["mem_00001"] == ("exact", "mem_00000")
    assert got["mem_00002"] == ("near", "mem_00000")
    assert got["mem_00003"] == (None, None)


def test_dedupe_like_a_greedy_model(spark):
    """One pass in order: digests of kept cards only, then the first kept card of the slot that is near."""
    rng = random.Random(5)
    values = ["".join(rng.choices("ab ", k=6)) + "tail of a claim" for _ in range(30)]
    values += [values[0], *rng.choices(values, k=15)]
    kept, want, digests = [], {}, {}
    for i, v in enumerate(values):
        near = next((k for k, x in kept if model_similarity(v, x) >= 0.88), None)
        if v in digests:
            want[i] = ("exact", digests[v])
        elif near is not None:
            want[i] = ("near", near)
        else:
            want[i] = (None, None)
            digests[v] = i
            kept.append((i, v))
    got = {int(r["id"][4:]): (r["reason"], r["into"] and int(r["into"][4:])) for r in C.deduplicated(cards(spark, values)).collect()}
    assert got == want and {x for x, _ in want.values()} == {None, "exact", "near"}


def test_a_copy_of_a_near_card_is_near(spark):
    got = {r["id"]: (r["reason"], r["into"]) for r in C.deduplicated(cards(spark, ["conclusion first", "conclusion first!!", "conclusion first!!"])).collect()}
    assert got["mem_00001"] == got["mem_00002"] == ("near", "mem_00000")


def test_proposals(spark):
    def action(values):
        return C.proposals(cards(spark, values), "2024-01-10 00:00:00").first()

    assert action(["same", "same"])["action"] == "merge"
    assert action(["uses vim", "no longer uses vim"])["action"] == "supersede"
    assert action(["uses vim", "uses emacs"])["action"] == "escalate"


def test_free_ids(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord int, name string")
    used = spark.createDataFrame([("mem_00002",), ("mem_00004",)], "id string")
    got = {r["name"]: r["new_id"] for r in C.assigned_ids(new, used, 1).collect()}
    assert got == {"a": "mem_00001", "b": "mem_00003", "c": "mem_00005"}


def texts(spark, text):
    return spark.createDataFrame([("f", text)], "source string, text string")


def test_markdown_sections(spark):
    got = R.markdown(texts(spark, "intro\n# One\na\n## Two\nb")).orderBy("seq").collect()
    assert [(r["section"], r["text"], r["locator"]) for r in got] == [(None, "intro", "L1-1"), ("One", "# One\na", "L2-3"), ("Two", "## Two\nb", "L4-5")]


def test_log_and_turns(spark):
    log = R.log_lines(texts(spark, "head\n2024-01-01 10:00 a\nmore\n (2024/01/01) b\n10:01:00 c\n10:01 d")).orderBy("seq").collect()
    assert [r["text"] for r in log] == ["head", "2024-01-01 10:00 a\nmore", "(2024/01/01) b", "10:01:00 c\n10:01 d"]
    assert [r["section"] for r in log] == [None, "2024-01-01", "2024/01/01", "10:01:00"]
    turns = R.turns(texts(spark, "User: hi\nthere\nassistant:yes\n用户: x\nAI: hello\n\nHuman:\n \nhuman: y")).orderBy("seq").collect()
    assert [r["section"] for r in turns] == ["User:", "assistant:", "用户:", "AI:", "human:"]
    assert [r["text"] for r in turns] == ["User::\nhi\nthere", "assistant::\nyes", "用户::\nx", "AI::\nhello", "human::\ny"]
    assert [r["text"] for r in R.turns(texts(spark, "so\nA. b\nB+ c\nA d"), "A.|B+").orderBy("seq").collect()] == ["(未标注):\nso", "A.:\nb", "B+:\nc\nA d"]


def test_csv_quotes(spark):
    got = R.csv_rows(texts(spark, 'name,note\nann,"a, b"\nbob,')).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["name: ann\nnote: a, b", "name: bob"]


def test_recipe_dispatch(spark):
    df = spark.createDataFrame([("a", "x\ny", "lines"), ("b", "x\n\ny", "blank_line"), ("c", "x\ny", "strange"), ("d", "x\n---\ny\n---\n...", "record_separator")], "source string, text string, strategy string")
    got = R.by_recipe(df).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 2, "b": 2, "c": 1, "d": 2}


def model_chunks(lengths, budget, most):
    """(records, chars) of each chunk: long records flush and give a chunk for each of their windows."""
    out, cur, used = [], 0, 0
    for n in lengths:
        if cur and (used + n + 2 > budget or cur >= most):
            out.append((cur, used))
            cur = used = 0
        if n > budget:
            if cur:
                out.append((cur, used))
                cur = used = 0
            step = int(budget * 0.85)
            out += [(1, min(step, n - i)) for i in range(0, n, step)]
            continue
        cur, used = cur + 1, used + n + 2
    return out + ([(cur, used)] if cur else [])


@pytest.mark.parametrize("budget", [64, 100, 1000])
def test_chunks_like_the_sequential_packing(spark, budget):
    rng = random.Random(budget)
    lines = ["x" * rng.randint(1, 300) for _ in range(80)]
    got = R.chunks(R.by_lines(texts(spark, "\n".join(lines))), budget, 5).orderBy("chunk").collect()
    assert [(r["record_count"], r["chars"]) for r in got] == model_chunks(list(map(len, lines)), budget, 5)


def test_windows_of_long_records_stand_alone(spark):
    records = R.by_lines(texts(spark, "y" * 110 + "\n" + "z" * 10)).withColumn("locator", F.lit("L1-1"))
    got = R.chunks(records, 100).orderBy("chunk").collect()
    assert [r["record_count"] for r in got] == [1, 1, 1] and [r["chars"] for r in got] == [85, 25, 12]
    assert 'loc="L1-1 (part 2/2)"' in got[1]["text"] and {r["kind"] for r in R.sliced(records, 100).collect()} == {"line", "line-part"}
    assert R.chunks(records, 100, cap=30).orderBy("chunk").first()["text"].endswith(R.CUT_OFF)


def test_records_are_trimmed_of_all_white_space(spark):
    got = [r["text"] for r in R.by_lines(texts(spark, "\tone\t\r\n two\u00a0\u3000\n \ufeff \nthree")).orderBy("seq").collect()]
    assert got == ["one", "two", "three"]
    assert [r["text"] for r in R.by_blank_lines(texts(spark, "\ta b\n\n  \n\nc\n")).orderBy("seq").collect()] == ["a b", "c"]


@pytest.mark.parametrize("split", [R.by_lines, R.by_sentences, R.markdown, R.log_lines, R.yaml_blocks, R.turns, R.csv_rows, R.by_separator])
def test_splitters_shuffle_nothing(spark, split):
    plan = split(texts(spark, "a\nb"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_numbers_across_sources(spark):
    df = spark.createDataFrame([(f"s{i:02d}", k) for i in range(20) for k in range(i % 4 + 1)], "source string, chunk int")
    got = [r["number"] for r in R.numbered_across(df).orderBy("source", "chunk").collect()]
    assert got == list(range(len(got)))
    assert R.chunk_of(R.numbered_across(df), "3").count() == 1 and R.chunk_of(df.withColumn("number", F.lit(0)), "s03-2").count() == 1


def test_free_ids_among_many(spark):
    rng = random.Random(3)
    taken = set(rng.sample(range(1, 400), 150))
    used = spark.createDataFrame([(f"mem_{k:05d}",) for k in taken] + [("odd",)], "id string")
    new = spark.createDataFrame([(i,) for i in range(120)], "ord int")
    got = [int(r["new_id"][4:]) for r in C.assigned_ids(new, used, 20).orderBy("ord").collect()]
    free = [k for k in range(20, 10_000) if k not in taken]
    assert got == free[:120]


def test_search_signals(spark):
    rows = [("mem_1", 1, "team:all", "reply_style", "short replies", ["Style"], ["how to answer", "回复风格"], "body"), ("mem_2", 2, "team:", "other", "nothing here", ["plain"], [], "b"), ("mem_3", 3, "u:x", "yy", "我们用中文", ["中文"], [], "b")]
    df = spark.createDataFrame(rows, "id string, num long, subject string, predicate string, value string, tags array<string>, aliases array<string>, body string").withColumns(
        {"slot": T.slot(F.col("subject"), F.col("predicate")), "title": F.lit("t"), "status": F.lit("active"), "importance": F.lit(0.5), "confidence": F.lit(0.5), "hits": F.lit(0), "recorded_at": F.lit("2024-01-01").cast("timestamp"), "valid_from": F.lit(None).cast("date")})

    def hit(query, **k):
        return {r["id"]: r for r in C.search(df, query, "2024-03-01 00:00:00", **k).collect()}

    # underscores, dashes and colons are taken out of the query, blanks stay
    assert hit("the reply-style of team:all")["mem_1"]["slot_exact"] == pytest.approx(1.2)
    assert hit("a short reply style")["mem_1"]["slot_exact"] == 0
    # an empty last part of a subject is no hit
    assert "mem_2" not in hit("zzz")
    assert hit("回复风格")["mem_1"]["alias_hit"] > 0 and hit("中文")["mem_3"]["tag_hit"] == 1.0
    assert hit("zzz", compat_tag_hit=True).keys() == {"mem_2", "mem_3"}


def test_overlaid_settings():
    from slotwise.config import DEFAULT, UNKNOWN_TYPE

    c = DEFAULT.overlaid({"types": {"lesson": {"ttl_days": 7}, "rumour": {"importance": 0.1}, "fact": (1, 0.2, 3, False)}, "weights": {"lexical": 2.0}})
    assert c.types["lesson"] == (7, *DEFAULT.types["lesson"][1:]) and c.types["rumour"] == (UNKNOWN_TYPE[0], 0.1, *UNKNOWN_TYPE[2:]) and c.types["fact"] == (1, 0.2, 3, False)
    assert c.weights["lexical"] == 2.0 and c.weights["importance"] == DEFAULT.weights["importance"] and DEFAULT.types["lesson"][0] != 7


def test_hashes_of_characters_beyond_the_first_plane(spark):
    def model(t):
        h = 2166136261
        raw = t.encode("utf-16-le")
        for b in (int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)):
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    for t in ("a", "slot::é", "😀 x", "中文"):
        assert one(spark, T.fnv1a(F.col("t")), t=t) == model(t)


def test_structure_of_texts(spark):
    rows = [("j", '{"a": 1}\n{"role": "user", "content": [{"text": "x"}]}\n[1\nplain'), ("c", "a,b,c\n1,2,3\n"), ("k", "# T\nkey: v\n  in: 1\n---\n2024-01-01 10:00 x\n"), ("v", '[1, {"b": 2}]'), ("e", "")]
    got = {r["source"]: r for r in S.structure(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert (got["j"]["lines"], got["j"]["json_line_rate"], got["j"]["nested_lines"], got["j"]["roles"]["user"]) == (4, 0.5, 1, 1)
    assert (got["c"]["csv_like"], got["c"]["csv_columns"], got["c"]["tsv_like"]) == (True, 3, False)
    assert (got["k"]["headings"], got["k"]["yaml_keys"], got["k"]["indented_rate"], got["k"]["stamp_rate"], got["k"]["separators"]) == (1, 1, 0.2, 0.2, ["\n---\n"])
    assert (got["v"]["json_valid"], got["v"]["json_root"], got["e"]["lines"], got["e"]["json_valid"]) == (True, "array(2)", 0, False)


def test_card_files_round_trip(spark):
    rows = [("mem_00001", "lesson", 'say "hi": now', "a:b", "p", "yes", "active", "x", 0.5, 0.25, dt.date(2024, 1, 1), None, 3, ["a", "b"], "line 1\nline 2")]
    df = spark.createDataFrame(rows, "id string, type string, title string, subject string, predicate string, value string, status string, source string, confidence double, importance double, valid_from date, valid_to date, hits int, tags array<string>, body string")
    back = S.parsed_cards(S.rendered(df)).first()
    assert back["problem"] is None and back["value"] == "yes" and back["tags"] == ["a", "b"] and back["body"] == "line 1\nline 2" and back["valid_to"] is None and back["hits"] == 3
    odd = spark.createDataFrame([("x/a.md", "  \\---\r\nid: mem_1\r\n  ---\r\nbody"), ("x/b.md", "plain"), ("x/c.md", "---\ntitle: t\n---\n"), ("x/README.md", "no")], "path string, text string")
    assert {r["path"]: r["problem"] for r in S.parsed_cards(odd).collect()} == {"x/a.md": None, "x/b.md": "no_front_matter", "x/c.md": "no_id"}


@pytest.mark.parametrize(("text", "path", "want"), [
    ("a\nb", "x.md", "markdown"), ("2024-01-01 10:00 a\n2024-01-01 10:01 b\n2024-01-01 10:02 c", "x", "log"), ('{"a": 1}', "x", "json"),
    ('{"a":1}\n{"a":2}\n{"a":3}', "x", "jsonl"), ("a: 1\nb:\n  - c\n  - d", "x", "yaml"), ("a,b,c\n1,2,3", "x", "csv"), ("just words", "x", "text"), ("", "x", "text")])
def test_sniffing(spark, text, path, want):
    assert one(spark, S.sniffed(F.col("t"), F.col("p")), t=text, p=path) == want


def test_trial_mode_writes_nothing(spark, tmp_path):
    with pytest.raises(S.ReadOnly):
        S.write_cards(cards(spark, ["a"]), str(tmp_path / "out"), "trial")
    assert not (tmp_path / "out").exists()


def test_samples_repeat_and_spread(spark):
    rows = [(f"id{i:03d}", f"s{i % 7}", "active" if i % 2 else "expired", f"t{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, slot string, status string, type string")
    assert C.sampled(df, 10, 1).collect() == C.sampled(df.repartition(3), 10, 1).collect()
    assert C.spread(df, 7, 1).select("slot").distinct().count() == 7
    assert C.stratified(df, 10, 1).count() == 10


def test_stream_state_like_batch(spark, tmp_path):
    from slotwise.streaming.stream import audit_stream, slot_state

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id":"1","slot":"s","value":"x","recorded_at":"2024-01-01T00:00:00"}\n{"id":"2","slot":"s","value":"y","recorded_at":"2024-01-02T00:00:00"}\n{"id":"3","slot":"t","value":"y","recorded_at":"2024-01-02T00:00:00"}\n')
    q = slot_state(audit_stream(spark, str(src), "id string, slot string, value string, recorded_at timestamp")).writeStream.outputMode("complete").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["slot"], r["newest"], r["claims"], r["conflict"]) for r in spark.table("slots").collect()} == {("s", "2", 2, True), ("t", "3", 1, False)}


def test_upserts_keep_the_newest(spark, tmp_path):
    from slotwise.streaming.stream import compacted, upsert, upserted

    path, sink = str(tmp_path / "t"), None
    sink = upsert(path)
    day = lambda d: dt.datetime(2024, 1, d)
    batches = [[("a", 1, day(1)), ("a", 2, day(2)), ("b", 1, day(1))], [("a", 3, day(2)), ("c", 1, day(1))], [("b", 0, day(1)), ("c", 2, day(3))]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch changes nothing
            sink(spark.createDataFrame(rows, "id string, v int, recorded_at timestamp"), n)
    want = {("a", 3), ("b", 0), ("c", 2)}
    assert {(r["id"], r["v"]) for r in upserted(spark, path).collect()} == want
    compacted(spark, path)
    assert {(r["id"], r["v"]) for r in upserted(spark, path).collect()} == want
    sink(spark.createDataFrame([("a", 4, day(9))], "id string, v int, recorded_at timestamp"), 3)
    assert {(r["id"], r["v"]) for r in upserted(spark, path).collect()} == {("a", 4), ("b", 0), ("c", 2)}


def test_front_matter_is_folded_only_where_it_has_items(spark):
    at = "---\nid: 1\nsubject: a: b\n%ssubject: c\nvalid_from: 2024-1-5\nrecorded_at: 2024-01-05T07:08\nended_at: 2024-01-05 07:08\nlast_hit: 07:08:09\n---\nbody"
    df = spark.createDataFrame([("x/1.md", at % ""), ("x/2.md", at % "tags:\n- a\n- b\n"), ("x/3.md", "none")], "path string, text string")
    one, two, none = S.parsed_cards(df, F.lit("2024-03-01").cast("timestamp")).orderBy("path").collect()
    assert [(r["id"], r["subject"], str(r["valid_from"]), str(r["recorded_at"]), str(r["ended_at"]), r["last_hit"], r["body"]) for r in (one, two)] == [("1", "c", "2024-01-05", "2024-01-05 07:08:00", "None", None, "body")] * 2
    assert (one["tags"], two["tags"], none["problem"], none["tags"], none["type"]) == ([], ["a", "b"], "no_front_matter", [], "lesson")
    # what a column reads is worked out in the steps below it, not again for each column
    plan = S.parsed_cards(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
