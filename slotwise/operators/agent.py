"""Results of an external extractor: loose JSON to cards, recipes, progress."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.config import TYPES

# The names of the ways to split, and what a path into an object looks like.
STRATEGIES = ("lines", "jsonl", "json_array", "conversation", "record_separator", "markdown", "yaml", "csv", "log", "blank_line", "whole")
PATH = re.compile(r"^[a-zA-Z_$][\w$]*(\[\])?(\.[a-zA-Z_$][\w$]*(\[\])?)*$")
# Starting brackets that are tried in a text around JSON; cards that a result, and a chunk of an own extraction, may give.
MOST_STARTS = 4
MOST_CARDS, MOST_OF_CHUNK = 60, 40
# Other names of a card's fields, by rank.
ALIASES = {"type": ("type", "category"), "title": ("title", "name"), "subject": ("subject", "slot"), "predicate": ("predicate",), "value": ("value", "key"), "body": ("body", "content", "text", "desc", "summary")}
#: Fields without other names, and lists.
PLAIN = ("status", "confidence", "importance", "valid_from", "valid_to")
LISTS = {"tags": ("tags",), "aliases": ("aliases", "alias"), "links": ("links",), "supersedes": ("supersedes",)}
# Other names of the types.
LABELS = {
    "身份": "profile", "身份事实": "profile", "偏好": "preference", "偏好约定": "preference", "环境": "environment", "环境事实": "environment",
    "项目": "project", "进行中工作": "project", "规程": "procedure", "操作规程": "procedure", "流程": "procedure", "教训": "lesson", "经验": "lesson",
    "经验教训": "lesson", "决策": "decision", "决策记录": "decision", "事件": "episode", "事件记录": "episode",
}


def loose(text: str | None):
    """JSON in a text: all of it, a fenced block, or the first of its balanced stretches that is a list or has cards; None if there is none."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    for part in (text, fenced[1] if fenced else None):
        try:
            if part is not None:
                return json.loads(part)
        except ValueError:
            pass
    decoder, source = json.JSONDecoder(), fenced[1] if fenced else text
    for m in list(re.finditer(r"[\[{]", source))[:MOST_STARTS]:
        try:
            x = decoder.raw_decode(source, m.start())[0]
        except ValueError:
            continue
        # amid words only a list, or an object with a list of cards, is a result
        if isinstance(x, list) or isinstance(x, dict) and isinstance(x.get("cards"), list):
            return x
    return None


def listed_in(value) -> list | None:
    """The list that a result holds, whatever it is called; an object that holds none is no card."""
    if isinstance(value, dict):
        named = next((value[k] for k in ("cards", "memories", "items") if isinstance(value.get(k), list)), None)
        if named is None and value.get("card"):
            return [value["card"]]
        return named if named is not None else next((v for v in value.values() if isinstance(v, list) and v and isinstance(v[0], (dict, list))), None)
    return value if isinstance(value, list) else None


def cards_in(value, most: int | None = None) -> list[dict]:
    """The objects among the first `most` entries of a result's list."""
    return [x for x in (listed_in(value) or [])[:most] if isinstance(x, dict)]


def said(value) -> str | None:
    """A field's value as text, JSON's way."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (bool, int, float, list, dict)) else str(value)


def coerced(raw: dict) -> dict:
    """A card's fields from an object with other names; a slot gives subject and predicate, a title the value.

    Lists given as text are cut at commas; single entries are lists of one.
    """
    out = {k: next((raw[n] for n in names if n in raw), None) for k, names in ALIASES.items()}
    for slot in (out["subject"] if not out["predicate"] else None, raw.get("slot") if not out["subject"] else None):
        if isinstance(slot, str) and "::" in slot:
            out["subject"], out["predicate"] = slot.split("::")[:2]
    out["value"] = out["value"] or out["title"]
    if out["type"]:
        kind = str(out["type"]).strip()
        out["type"] = kind.lower() if kind.lower() in TYPES else LABELS.get(kind, kind.lower())
    out = {k: said(v) for k, v in (out | {k: raw.get(k) for k in PLAIN}).items()}
    for k, names in LISTS.items():
        own = next((raw[n] for n in names if raw.get(n)), [])
        own = re.split("[,，、]", own) if isinstance(own, str) and k in ("tags", "aliases") else own if isinstance(own, list) else []
        out[k] = [t for t in ((said(x) or "").strip() for x in own) if t]
    return out


def extracted(results: DataFrame, most: int = MOST_CARDS) -> DataFrame:
    """Cards of results (chunk, text), from at most so many entries of each; a result without cards gives one row with an error.

    Results of an own extraction, a chunk each, go by MOST_OF_CHUNK instead.

    error: no_json, or no_cards for JSON that has none.
    """
    names = ["chunk", "ord", *ALIASES, *PLAIN, *LISTS, "error"]

    def run(batches):
        for b in batches:
            rows = []
            for chunk, text in zip(b["chunk"], b["text"], strict=True):
                value = loose(text)
                found = [coerced(x) for x in cards_in(value, most)]
                none = {"chunk": chunk, "ord": 0, **dict.fromkeys((*ALIASES, *PLAIN)), **{k: [] for k in LISTS}, "error": "no_json" if value is None else "no_cards"}
                rows += [{"chunk": chunk, "ord": i, **c, "error": None} for i, c in enumerate(found)] or [none]
            yield pd.DataFrame(rows, columns=names)

    fields = ", ".join([f"{k} string" for k in (*ALIASES, *PLAIN)] + [f"{k} array<string>" for k in LISTS])
    return results.select("chunk", "text").mapInPandas(run, f"chunk string, ord int, {fields}, error string")


def of_chunks(results: DataFrame) -> DataFrame:
    """Cards of results (chunk, text) of an own extraction: at most MOST_OF_CHUNK entries of each count."""
    return extracted(results, MOST_OF_CHUNK)


def recipe_problem(strategy: Column, fields: Column) -> Column:
    """Why a splitting recipe is not usable; null if it is."""
    bad = F.exists(F.map_values(F.coalesce(fields, F.create_map().cast("map<string,string>"))), lambda p: ~p.rlike(PATH.pattern))
    return F.when(~F.coalesce(strategy.isin(*STRATEGIES), F.lit(False)), "unknown_strategy").when(bad, "bad_path")


def progress(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """State of each chunk of a task: missing, error or ok."""
    r = results.groupBy("chunk").agg(F.count_if(F.col("error").isNull()).alias("cards"), F.count("*").alias("rows"))
    return manifest.join(r, "chunk", "left").select("chunk", F.when(F.col("rows").isNull(), "missing").when(F.col("cards") == 0, "error").otherwise("ok").alias("state"), F.coalesce("cards", F.lit(0)).alias("cards"))


def recipe_progress(manifest: DataFrame, recipes: DataFrame) -> DataFrame:
    """State of the recipe of each source of a manifest: missing, invalid (and why) or ok."""
    r = recipes.select("source", F.lit(True).alias("_has"), recipe_problem(F.col("strategy"), F.col("fields")).alias("problem")).dropDuplicates(["source"])
    state = F.when(F.col("_has").isNull(), "missing").when(F.col("problem").isNotNull(), "invalid").otherwise("ok")
    return manifest.join(r, "source", "left").select("source", state.alias("state"), "problem")
