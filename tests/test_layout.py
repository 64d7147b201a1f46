"""Folders of collections and tasks, and the guard of trial packages."""

from __future__ import annotations

import pytest

from slotwise.sources import layout as L
from slotwise.sources import sinks
from slotwise.sources.cards import ReadOnly
from slotwise.sources.claims import claims


def test_a_new_collection(spark, tmp_path):
    root = str(tmp_path / "palace")
    assert L.target_problem(spark, root) == "NOT_FOUND" and L.target_problem(spark, None) == "NOT_FOUND"
    L.init(spark, root)
    assert L.target_problem(spark, root) is None and L.target_problem(spark, f"{root}/{L.SEQUENCE}") == "NOT_A_DIRECTORY"
    assert {"decision", "lesson"} <= {p.name for p in (tmp_path / "palace" / "cards").iterdir()}
    assert L.sequence(spark, root) == 0 and L.sequence(spark, root, 17) == 17 and L.sequence(spark, root, 5) == 17
    L.init(spark, root)  # what is there stays
    assert L.sequence(spark, root) == 17


def test_folders_one_level(spark, tmp_path):
    for name in ("b.md", "a.md", "sub/c.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = [p.rsplit("/", 1)[1] for p in L.expanded(spark, [str(tmp_path), str(tmp_path / "sub" / "c.md"), str(tmp_path / "none")])]
    assert got == ["a.md", "b.md", "c.md"]


def test_task_registry(spark, tmp_path):
    space, one = str(tmp_path / "space"), tmp_path / "one"
    one.mkdir()
    assert L.task_folder(spark, space, str(one)) == str(one)
    L.register(spark, space, "t1", "task", str(tmp_path / "gone"), "2024-01-01")
    assert L.task_folder(spark, space, "t1") is None
    L.register(spark, space, "t1", "trial", str(one), "2024-01-02")
    assert L.task_folder(spark, space, "t1") == str(one) and L.tasks(spark, space).first()["kind"] == "trial"


def test_a_trial_package_writes_nothing(spark, sf, tmp_path):
    texts = spark.createDataFrame([("a.md", "# x\ny", "markdown")], "source string, text string, format string")
    for kind in ("agent", "trial"):
        m = sinks.write_task(texts, str(tmp_path / kind), kind=kind, existing_slots=("s::p",) * 99)
        assert [r["result"] for r in m.orderBy("chunk").collect()] == ["results/a-md-0000.result.json", "results/a-md-0001.result.json"]
        assert (tmp_path / kind / "results").is_dir() and L.mode_of(spark, str(tmp_path / kind)) == kind
        assert "# x" in "".join(p.read_text() for p in (tmp_path / kind / "all").glob("*.txt"))
    few = claims(spark, sf).where("num <= 5")
    sinks.write_from_task(few, str(tmp_path / "agent"), str(tmp_path / "out"))
    with pytest.raises(ReadOnly):
        sinks.write_from_task(few, str(tmp_path / "trial"), str(tmp_path / "out2"))
    assert (tmp_path / "out").exists() and not (tmp_path / "out2").exists()


def test_parameters_of_a_full_run():
    got = L.full_run("full", None, None, None, {"strategy": "slot", "seed": 3, "count": 5, "pool": 9, "scope": "all"})
    assert got["mode"] == "full" and got["budget"] == 6000 and got["sample"] is None and got["carried_from"]["count"] == 5
    assert L.full_run()["mode"] == "trial" and L.full_run()["carried_from"] is None
