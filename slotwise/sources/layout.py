"""Folders of a collection and of tasks, on any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.config import DEFAULT, Config
from slotwise.operators.records import BUDGET

# A collection's folders, and the file of its last number.
FOLDERS = ("cards", "maps", "entries", "archive", ".palace")
SEQUENCE = ".palace/seq.txt"
TASKS = "tasks"
MANIFEST = "task.json"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_file(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _at(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def target_problem(spark: SparkSession, path: str | None) -> str | None:
    """Why a path can't be a collection: NOT_FOUND, NOT_A_DIRECTORY or NO_PERMISSION; None if it can."""
    if not path:
        return "NOT_FOUND"
    fs, at = _at(spark, path)
    try:
        if not fs.exists(at):
            return "NOT_FOUND"
        if not fs.getFileStatus(at).isDirectory():
            return "NOT_A_DIRECTORY"
        fs.listStatus(at)
    except Exception as e:  # the file system's own refusal
        if "AccessControl" in str(e) or "Permission" in str(e):
            return "NO_PERMISSION"
        raise
    return None


def init(spark: SparkSession, root: str, config: Config = DEFAULT) -> None:
    """Make a collection's folders, one of cards for each type, and its number 0, where they are missing."""
    for name in (*FOLDERS, *(f"cards/{t}" for t in config.types)):
        fs, at = _at(spark, f"{root}/{name}")
        fs.mkdirs(at)
    if read_file(spark, f"{root}/{SEQUENCE}") is None:
        write_file(spark, f"{root}/{SEQUENCE}", "0\n")


def sequence(spark: SparkSession, root: str, largest: int = 0) -> int:
    """A collection's last number, raised to `largest` if that is larger; what is no number counts as 0."""
    text = (read_file(spark, f"{root}/{SEQUENCE}") or "").strip()
    now = int(text) if text.isdigit() else 0
    if largest > now:
        write_file(spark, f"{root}/{SEQUENCE}", f"{largest}\n")
    return max(now, largest)


def expanded(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files, and the files that stand directly in folders, by name."""
    out = []
    for p in paths:
        fs, at = _at(spark, p)
        if not fs.exists(at):
            continue
        own = [at] if fs.getFileStatus(at).isFile() else [x.getPath() for x in fs.listStatus(at) if x.isFile()]
        out += sorted(x.toString() for x in own)
    return out


def register(spark: SparkSession, workspace: str, task: str, kind: str, folder: str, at: str) -> None:
    """Note a task's kind and folder; the latest note of a task counts."""
    spark.createDataFrame([(task, kind, folder, at)], "task string, kind string, folder string, at string").coalesce(1).write.mode("append").json(f"{workspace}/{TASKS}")


def tasks(spark: SparkSession, workspace: str) -> DataFrame:
    """(task, kind, folder) of all tasks."""
    notes = spark.read.schema("task string, kind string, folder string, at string").json(f"{workspace}/{TASKS}")
    return notes.groupBy("task").agg(F.max_by(F.struct("kind", "folder"), "at").alias("t")).select("task", "t.*")


def task_folder(spark: SparkSession, workspace: str, task: str) -> str | None:
    """Where a task is: its noted folder if that is there, else the task itself as a path."""
    row = tasks(spark, workspace).where(F.col("task") == task).first() if target_problem(spark, f"{workspace}/{TASKS}") is None else None
    return next((p for p in ([row["folder"]] if row else []) + [task] if target_problem(spark, p) is None), None)


def mode_of(spark: SparkSession, folder: str) -> str:
    """The mode that a package's own manifest names: writing to a collection from a trial is refused wherever it is called from."""
    text = read_file(spark, f"{folder}/{MANIFEST}")
    return json.loads(text).get("mode", "write") if text else "write"


def full_run(mode: str | None = None, budget: float | None = None, style: str | None = None, config: dict | None = None, sample: dict | None = None) -> dict:
    """Parameters of a run after a trial: its sample is told but not carried over, as a full run takes all records."""
    carried = {k: sample.get(k) for k in ("strategy", "scope", "seed", "count", "pool")} if sample else None
    return {"mode": "full" if mode == "full" else "trial", "budget": budget or BUDGET, "style": style or "auto", "sample": None, "config": config, "carried_from": carried}
