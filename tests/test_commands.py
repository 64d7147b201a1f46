from __future__ import annotations

import json

import pytest

from slotwise.__main__ import CARDS, FOLDERS, TEXTS, run


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("cards")
    for n, value in ((1, "short answers"), (2, "long answers")):
        (top / f"mem_0000{n}.md").write_text(f"---\nid: mem_0000{n}\ntype: preference\ntitle: Reply style {n}\nsubject: user\npredicate: reply_style\nvalue: {value}\nstatus: active\nrecorded_at: 2024-01-0{n}\ntags: [style]\n---\nAnswers are {value}.\n")
    return str(top)


@pytest.mark.parametrize("command", sorted({*CARDS, *TEXTS, "types"}))
def test_every_command(spark, folder, tmp_path, command):
    got = list(map(json.loads, run(spark, [command, folder, "mem_00001" if command in ("show", "template") else "reply style", "--now", "2024-02-01 00:00:00", "--out", str(tmp_path / "out")])))
    least = {"expire": 0, "gc": 0, "import": 0, "problems": 0, "types": 8, "show": 1, "conflicts": 1, "review": 0, "slots": 1, "template": 1}.get(command, 2)
    assert len(got) >= least


def test_the_table_follows_the_files(spark, folder, tmp_path):
    from slotwise.sources import sinks

    got = sinks.reindex(spark, folder, str(tmp_path / "table"))
    assert sorted(r["id"] for r in got.collect()) == ["mem_00001", "mem_00002"] and got.where("type = 'preference'").count() == 2


def test_a_collection_by_commands(spark, tmp_path):
    top, now = str(tmp_path / "held"), ["--now", "2024-02-01 10:00:00"]
    do = lambda *args: list(map(json.loads, run(spark, [*args, *now])))
    assert do("init", top) == [{"folder": top, "number": 0}]
    card = {"type": "lesson", "title": "Retries", "subject": "project:x", "predicate": "retries", "value": "three", "body": "Three are enough."}
    (one,) = do("add", top, json.dumps(card))
    assert one["ok"] and one["id"] == "mem_00001" and one["existing"] == []
    (two,) = do("add", top, json.dumps(card | {"value": "five", "body": "Better five."}))
    assert two["ok"] and two["existing"] == ["mem_00001"] and two["action"] is not None
    assert not do("add", top, json.dumps({"type": "lesson"}))[0]["ok"]
    assert do("validate", top) == [{"ok": 2, "rejected": 0}]
    assert do("resolve", top, "project:x::retries", "--verdict", "guess")[0]["error"] == "unknown_verdict"
    got = do("resolve", top, "project:x::retries", "--verdict", "supersede", "--winner", "mem_00002", "--out", str(tmp_path / "after"))
    assert {r["id"]: r["status"] for r in got} == {"mem_00001": "superseded", "mem_00002": "active"}
    assert do("reindex", top, "--out", str(tmp_path / "table")) == [{"type": "lesson", "n": 2}]
    (saved,) = do("backup", top, "--out", str(tmp_path / "backups"))
    assert spark.read.parquet(saved["path"]).count() == 2
    assert do("log", top, "went well")[0]["line"] == "went well" and [r["value"] for r in spark.read.text(f"{top}/entries/month=2024-02").collect()] == ["- went well"]


def test_a_tasks_status(spark, folder, tmp_path):
    at = tmp_path / "task"
    list(run(spark, ["task", folder, "--out", str(at)]))
    states = lambda: {r["chunk"]: (r["state"], r["cards"]) for r in map(json.loads, run(spark, ["status", str(at)]))}
    first, *others = sorted(states())
    assert set(states().values()) == {("missing", 0)}
    (at / "results" / f"{first}.result.json").write_text('{"cards": [{"title": "t"}]}')
    (at / "results" / f"{others[0]}.result.json").write_text("none")
    assert states()[first] == ("ok", 1) and states()[others[0]] == ("error", 0)
    assert sorted(FOLDERS) == ["add", "backup", "init", "log", "reindex", "resolve", "status", "validate"]
