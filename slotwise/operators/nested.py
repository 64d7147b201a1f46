"""Records out of JSON texts: rule walks, recipes over arrays and lines, path lookups.

The shapes are irregular, so texts go through Python in Arrow batches; a text
is handled on its own and nothing is gathered across texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Containers deeper than this are not searched for strings.
DEEPEST = 5
#: Bad lines of a JSONL text that are kept as records.
BAD_LINES = 3
LONGEST_WHOLE = 4000
#: Records, and characters of them, that a task holds before it hands them on.
MOST_RECORDS, MOST_CHARS = 5_000, 4_000_000
LINES = re.compile(r"\r?\n")
RECORD = "source {source}, pos int, kind string, locator string, text string"


def shown(value) -> str:
    """A scalar as JSON prints it; strings as they are."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def leaves(node, label: str = "", depth: int = 0, in_lists: bool = True) -> Iterator[str]:
    """"label: string" of all non-blank strings below a node, labels dotted; in_lists: strings directly in a list count too."""
    if depth > DEEPEST or not isinstance(node, (list, dict)):
        return
    own = isinstance(node, dict)
    for key, value in node.items() if own else ((None, x) for x in node):
        name = (f"{label}.{key}" if label else key) if own else label
        if not isinstance(value, str):
            yield from leaves(value, name, depth + 1, in_lists)
        elif value.strip() and (own or in_lists):
            yield f"{name}: {value}" if name else value


def picked(value, path: str) -> str | None:
    """What a path like a.b or a[].text finds, as text; several finds are joined by line breaks."""
    for step in path.split("."):
        key, spread = step.removesuffix("[]"), step.endswith("[]")
        if isinstance(value, list):
            found = [x[key] for x in value if isinstance(x, dict) and key in x]
            value = found or value
        elif isinstance(value, dict):
            value = value.get(key)
        else:
            return None
        if spread and isinstance(value, list):
            value = [x for x in value if x is not None]
    if isinstance(value, list):
        texts = [_element(x) for x in value if x is not None]
        return "\n".join(t for t in texts if t) or None
    return None if value is None or value == "" else shown(value)


def _element(x) -> str:
    if isinstance(x, dict):
        return next((x[k] for k in ("text", "content") if isinstance(x.get(k), str)), None) or shown(x)
    return shown(x)


def by_fields(value, fields: dict[str, str], meta: list[str]) -> str:
    """"label: found" of a recipe's fields, then of its further keys; what isn't found is left out."""
    asked = [*fields.items(), *((k, k) for k in meta)]
    return "\n".join(f"{label}: {found}" for label, path in asked if (found := picked(value, path)) is not None)


def _summary(v) -> str | None:
    """What is shown of a field that is no string: sizes of lists, marks for objects, scalars; nothing for null."""
    if v is None:
        return None
    return f"[{len(v)} items]" if isinstance(v, list) else "{...}" if isinstance(v, dict) else shown(v)


def walked(value, name: str) -> Iterator[tuple[str, str, str]]:
    """(kind, locator, text): objects that are mostly strings are records; other containers are gone down into."""
    todo = [(value, name)]
    while todo:
        node, at = todo.pop()
        if isinstance(node, str) and node.strip():
            yield "json-string", at, node
        elif isinstance(node, list):
            todo += [(x, f"{at}[{i}]") for i, x in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            texts = {k: v for k, v in node.items() if isinstance(v, str) and v.strip()}
            if not texts or 2 * len(texts) < len(node):
                todo += [(v, f"{at}.{k}") for k, v in reversed(node.items())]
                continue
            rest = {k: v for k, v in node.items() if k not in texts}
            other = [f"{k}: {s}" for k, v in rest.items() if (s := _summary(v)) is not None]
            yield "json-object", at, "\n".join([*(f"{k}: {v}" for k, v in texts.items()), *leaves(rest, in_lists=False), *other])


def _records(texts: DataFrame, parse: Callable[[pd.Series], Iterator[tuple[str, str, str]]]) -> DataFrame:
    """Records of (source, text, ...) by a function of a row; blank texts have none."""
    schema = RECORD.format(source=texts.schema["source"].dataType.simpleString())

    def framed(rows):
        return pd.DataFrame(rows, columns=["source", "pos", "kind", "locator", "text"])

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for r in b.itertuples(index=False):
                if isinstance(r.text, str) and r.text.strip():
                    for i, x in enumerate(parse(r)):
                        rows.append((r.source, i, *x))
                        held += len(x[2])
                        # one text may have any number of records
                        if len(rows) >= MOST_RECORDS or held >= MOST_CHARS:
                            yield framed(rows)
                            rows, held = [], 0
        yield framed(rows)

    return texts.mapInPandas(run, schema)


def _value(text: str):
    """(value, error)."""
    try:
        return json.loads(text), None
    except (ValueError, RecursionError) as e:
        return None, str(e)


def _walk_row(r):
    value, error = _value(r.text)
    if error:
        yield "parse-error", "fallback", f"[{error}]\n\n{r.text[:2000]}"
    else:
        yield from walked(value, str(r.source))


def _line_row(r):
    good = bad = 0
    for n, line in enumerate(LINES.split(r.text), 1):
        if not line.strip():
            continue
        value, error = _value(line)
        if error:
            bad += 1
            if bad <= BAD_LINES:
                yield "jsonl-invalid", f"line {n}", line
            continue
        good += 1
        found = [value] if isinstance(value, str) and value.strip() else list(leaves(value))
        yield "jsonl-line", f"line {n}", "\n".join(found) or shown(value)
    if bad:
        yield "meta-note", "summary", f"{good} lines parsed, {bad} lines are no JSON (the first {BAD_LINES} are kept)"


def _recipe(r) -> tuple[dict[str, str], list[str]]:
    fields = getattr(r, "fields", None)
    meta = getattr(r, "meta", None)
    return dict(fields) if fields is not None else {}, list(meta) if meta is not None else []


def _array_row(r):
    value, error = _value(r.text)
    if error:
        yield "whole", "whole-file", r.text[:LONGEST_WHOLE]
        return
    items = [(f"[{i}]", x) for i, x in enumerate(value)] if isinstance(value, list) else [("root", value)]
    fields, meta = _recipe(r)
    for at, x in items:
        text = by_fields(x, fields, meta) if isinstance(x, (dict, list)) else "" if x is None else shown(x)
        if text:
            yield "json-array", at, text


def _lines_by_recipe(r):
    fields, meta = _recipe(r)
    for n, line in enumerate(LINES.split(r.text), 1):
        if line.strip():
            value, error = _value(line)
            text = line if error else by_fields(value, fields, meta)
            if text:
                yield "jsonl", f"line {n}", text


def json_walk(texts: DataFrame) -> DataFrame:
    """Records of JSON texts (source, text); a text that is no JSON gives one record that says so."""
    return _records(texts.select("source", "text"), _walk_row)


def json_lines(texts: DataFrame) -> DataFrame:
    """A record a line with all its strings; the first bad lines are kept, and a note counts them."""
    return _records(texts.select("source", "text"), _line_row)


def json_array(texts: DataFrame) -> DataFrame:
    """Records of (source, text, fields, meta): an array's elements rendered by paths, scalars as they are."""
    return _records(texts.select("source", "text", "fields", "meta"), _array_row)


def lines_by_recipe(texts: DataFrame) -> DataFrame:
    """Records of (source, text, fields, meta): each line rendered by paths, a bad line as it is."""
    return _records(texts.select("source", "text", "fields", "meta"), _lines_by_recipe)
