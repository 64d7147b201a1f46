"""Card files and other text files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.temporal import normalized_date, parsed
from slotwise.functions.text import SPACES, digest, quoted, slot

# What stands around a card's front matter, and the largest file.
FENCED = r"(?s)\A[ \t]*\\?---[ \t]*\r?\n(.*?)\r?\n[ \t]*\\?---[ \t]*(?:\r?\n(.*))?\z"
MOST_BYTES = 8 * 1024 * 1024


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of all files below a folder; files over 8 MiB have no text but a problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.col("length") <= MOST_BYTES
    return files.select("path", F.when(small, F.decode("content", "UTF-8")).alias("text"), F.when(~small, F.lit("too_large")).alias("problem"))


def scalar(raw: Column) -> Column:
    """A value as the text that it stands for: quotes taken off, null words null, numbers in their plain form.

    Zero, false and empty values count as missing, as they always have in card files.
    """
    s, low = F.trim(raw), F.lower(F.trim(raw))
    whole = F.regexp_replace(s, r"^(-?)0+(?=\d)", "$1")
    plain = F.regexp_replace(F.regexp_replace(whole, r"0+$", ""), r"\.$", ".0")
    return (
        F.when(s.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(s) > 1), F.nullif(F.substr(s, F.lit(2), F.length(s) - 2), F.lit("")))
        .when(low.isin("", "null", "none", "~", "false", "no", "off"), None).when(low.isin("true", "yes", "on"), "True")
        .when(s.rlike(r"^-?\d+$"), F.when(~s.rlike("^-?0+$"), whole)).when(s.rlike(r"^-?\d+\.\d+$"), F.when(~s.rlike(r"^-?0+\.0+$"), plain)).otherwise(s))


def _matter_lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\r?\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & (x.startswith("- ") | F.contains(x, F.lit(":"))))


def front_matter(block: Column) -> Column:
    """(key, value, items) of "key: value" lines in order, indented ones too, values raw; items: the "- item" lines that follow, raw."""
    return _matter(_matter_lines(block))


def _matter(lines: Column) -> Column:
    """`front_matter` of its lines; they are folded only where there are items."""
    empty = F.array().cast("array<struct<key:string,value:string,items:array<string>>>")

    def pair(x):
        return F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"), F.array().cast("array<string>").alias("items"))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(last["key"].alias("key"), last["value"].alias("value"), F.concat(last["items"], F.array(F.trim(F.substring(x, 3, 1 << 30)))).alias("items"))
        item = F.when(F.size(acc) == 0, acc).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more)))
        return F.when(x.startswith("- "), item).otherwise(F.concat(acc, F.array(pair(x))))

    return F.when(F.exists(lines, lambda x: x.startswith("- ")), F.aggregate(lines, empty, step)).otherwise(F.transform(lines, pair))


def list_of(last: Column) -> Column:
    """A key's (value, items) as a list: [a, b], the items below it, or a list of the value itself."""
    raw, items = last["value"], last["items"]
    inner = F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ",")
    given = F.when(raw.rlike(r"^\[.*\]$"), F.concat(inner, items)).when((F.size(items) > 0) | (raw == ""), items).otherwise(F.array(raw))
    return F.coalesce(F.filter(F.transform(given, scalar), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def samples(texts: DataFrame, head: int = 3000, tail: int = 1200, path: Column | None = None) -> DataFrame:
    """What a recipe's author is shown of texts: (source, chars, head, tail, format) and all of `structure`.

    tail: the end of a text longer than both.  format: as sniffed, by `path` or else the source.
    """
    long = F.length("text") > head + tail
    shown_tail = F.when(long, F.right("text", F.lit(tail)))
    named = F.col("source").cast("string") if path is None else path
    return structure(texts, F.length("text").alias("chars"), F.substring("text", 1, head).alias("head"), shown_tail.alias("tail"), sniffed(F.col("text"), named).alias("format"))


def parsed_cards(files: DataFrame, today: Column | None = None) -> DataFrame:
    """Cards of (path, text); files without front matter or id have a problem instead.

    A card without a type is a lesson, one without a status active.  Dates may
    be words like "today", which mean days before or at `today`, the current
    time if not given.
    """
    today = F.current_timestamp() if today is None else today
    base = files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^_|^README\.md$"))
    # each step is read by several columns of the next one, so that its work is done once a file, not once a reader;
    # pairs stand from the last to the first, and of a key the first one counts: only values that a column asks for are made plain,
    # in lambdas, as twenty of them written out are too much code for a compiled step
    base = base.select("path", F.col("text").rlike(FENCED).alias("fenced"), F.regexp_extract("text", FENCED, 1).alias("block"), F.trim(F.regexp_extract("text", FENCED, 2)).alias("body"))
    base = base.select("path", "fenced", "body", F.when(F.col("fenced"), _matter_lines(F.col("block"))).alias("lines"))
    base = base.select("path", "fenced", "body", F.reverse(_matter(F.col("lines"))).alias("m"))
    base = base.select("path", "fenced", "body", "m", F.transform("m", lambda p: p["key"]).alias("keys"))
    base = base.select("path", "fenced", "body", *[F.get("m", (F.array_position("keys", k) - 1).cast("int")).alias(f"m_{k}") for k in KEYS])
    base = base.select("*", *[F.get(F.transform(F.array(F.col(f"m_{k}")["value"]), scalar), F.lit(0)).alias(f"plain_{k}") for k in KEYS])
    last = lambda k: F.col(f"m_{k}")
    get = lambda k: F.col(f"plain_{k}")
    defaults = {"type": "lesson", "status": "active"}
    texts = [(F.coalesce(get(k), F.lit(defaults[k])) if k in defaults else get(k)).alias(k) for k in ("id", "type", "title", "subject", "predicate", "value", "status", "source", "superseded_by")]
    number = lambda k, default: F.coalesce(last(k)["value"].try_cast("double"), get(k).try_cast("double"), F.lit(default)).alias(k)
    return base.select(
        "path", *texts, number("confidence", 0.8), number("importance", 0.6), *[parsed(get(k)).alias(k) for k in ("recorded_at", "ended_at", "last_hit")],
        *[normalized_date(get(k), today).try_cast("date").alias(k) for k in ("review_after", "valid_from", "valid_to")], F.coalesce(get("hits").try_cast("double").try_cast("int"), F.lit(0)).alias("hits"),
        *[list_of(last(k)).alias(k) for k in ("tags", "aliases", "links", "supersedes")],
        "body",
        F.when(~F.col("fenced"), "no_front_matter").when(get("id").isNull(), "no_id").alias("problem"))


def opened(spark: SparkSession, path: str) -> DataFrame:
    """Usable cards of a folder of card files, with number, slot and digest."""
    cards = parsed_cards(text_files(spark, path).where("problem is null").select("path", "text")).where("problem is null").drop("problem")
    num = F.coalesce(F.regexp_extract("id", r"(\d+)", 1).try_cast("long"), F.lit(0))
    own = cards.withColumns({"num": num, "slot": slot(F.col("subject"), F.col("predicate"))})
    return own.withColumn("digest", digest(F.col("slot"), F.col("value"), F.col("body")))


def sniffed(text: Column, path: Column) -> Column:
    """Format by extension, then by content: log, json, jsonl, yaml, csv, text, in that order."""
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: F.trim(x) != "")
    head = F.slice(lines, 1, 40)
    n = F.size(lines)
    share = lambda xs, rule: F.size(F.filter(xs, lambda x: x.rlike(rule))) / F.greatest(F.size(xs), F.lit(1))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    delims = [F.length(first) - F.length(F.replace(first, F.lit(d))) for d in (",", "\t", ";")]
    ten = F.slice(lines, 1, 10)
    even = lambda d: F.size(F.array_distinct(F.transform(ten, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d)))))) == 1
    # a sentence's commas or semicolons may be even by chance: blanks follow most of them, and a row of cells doesn't read on after a full stop
    # or end in one; runs of a symbol may trail both, but no cell is empty or quoted
    blank = r"""(?:([^\p{L}\p{N}_\s,;"'.])\1+)?(?:\s|$)"""
    spaced = lambda d: F.regexp_count(first, F.lit(rf"{d}(?=[!?]|{blank})"))
    prose = lambda d, k: first.rlike(rf"[.!?]{blank}") & ~first.rlike(rf"{d}[{d}\"']") & (2 * spaced(d) >= k) if d in ",;" else F.lit(False)
    csv = F.lit(False)
    for d, k in zip((",", "\t", ";"), delims, strict=True):
        csv = csv | ((k >= 2) & even(d) & (n >= 2) & ~prose(d, k))
    top = F.size(F.filter(lines, lambda x: x.rlike(r"^[A-Za-z_][\w-]*:( |$)")))
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    by_ext = F.when(ext.isin("md", "markdown"), "markdown").when(ext == "json", "json").when(ext.isin("jsonl", "ndjson"), "jsonl").when(ext.isin("yaml", "yml"), "yaml").when(ext.isin("csv", "tsv"), "csv").when(ext == "log", "log")
    # the parser reads the first value and ignores what follows it, so lines of objects are told apart first
    objects = (n >= 3) & (share(lines, r"^\s*\{.*\}\s*$") > 0.8)
    content = (
        F.when((F.size(head) >= 3) & (share(head, r"^\[?\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}") > 0.4), "log")
        .when(F.trim(text).rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull() & ~objects, "json")
        .when(objects, "jsonl")
        .when((top >= 2) & (share(lines, r"^\s+\S") > 0.2), "yaml").when(csv, "csv").otherwise("text"))
    return F.coalesce(by_ext, content)


def profile(texts: DataFrame) -> DataFrame:
    """Shape of texts (source, text): lines, blanks, headings, list items, JSON lines, stamps, lengths."""
    lines = F.split("text", "\r?\n", -1)
    count = lambda rule: F.size(F.filter("ls", lambda x: x.rlike(rule)))
    p = texts.select("source", F.length("text").alias("chars"), lines.alias("ls"))
    return p.select(
        "source", "chars", F.size("ls").alias("lines"), count(r"^\s*$").alias("blank_lines"), count(r"^#{1,6}\s+").alias("headings"), count(r"^\s*[-*]\s+").alias("list_items"),
        count(r"^\s*\{.*\}\s*$").alias("json_lines"), count(r"\d{4}-\d{2}-\d{2}").alias("stamped"), F.array_max(F.transform("ls", lambda x: F.length(x))).alias("longest_line"))


def rounded(x: Column) -> Column:
    return F.round(x, 2)


def structure(texts: DataFrame, *more: Column) -> DataFrame:
    """What a recipe's author wants to know of texts (source, text), 14 fields: lines, JSON, roles, tables, keys, stamps, separators.

    Rates are of the lines that are not blank; those of JSON and stamps divide
    by at most 200 of them, the stamps counted over all.
    """
    lines = F.filter(F.split("text", "\r?\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    p = texts.select("source", "text", lines.alias("ls"), *more)
    others = [c for c in p.columns if c not in ("source", "text", "ls")]
    n = F.size("ls")
    bare = lambda x: F.btrim(x, F.lit(SPACES))
    # parsers stop at the end of the first value; within brackets all of the text has to be one
    is_json = lambda x: bare(x).rlike(r"^[\[{]") & (F.coalesce(F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))), F.lit(0)) == 1)
    first = F.coalesce(F.get("ls", F.lit(0)), F.lit(""))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    many = lambda rule: F.size(F.filter("ls", lambda x: x.rlike(rule)))
    found = lambda rule: F.regexp_count("text", F.lit(rule))
    share = lambda k, of: F.when(n > 0, rounded(k / of)).otherwise(0.0)
    stamp = r"^\s*[\[(]?\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}|^\s*\d{2}:\d{2}:\d{2}|^\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
    marks = ["\n---\n", "\n===\n", "\n\n\n", "\n--\n"]
    split_by = [F.struct((F.size(F.split("text", r"\Q" + m + r"\E", -1)) - 1).alias("n"), F.lit(-i).alias("o"), F.lit(m).alias("separator")) for i, m in enumerate(marks)]
    separators = F.slice(F.sort_array(F.filter(F.array(*split_by), lambda x: x["n"] > 0), asc=False), 1, 3)
    whole = is_json(F.col("text"))
    keys = F.array_join(F.slice(F.json_object_keys("text"), 1, 8), ",")
    root = F.when(~whole, F.lit(None)).when(bare(F.col("text")).startswith("["), F.concat(F.lit("array("), F.json_array_length("text").cast("string"), F.lit(")"))).otherwise(keys)
    return p.select(
        "source", *others, n.alias("lines"), share(F.size(F.filter(F.slice("ls", 1, 200), is_json)), F.least(n, F.lit(200))).alias("json_line_rate"),
        F.size(F.filter(F.slice("ls", 1, 200), lambda x: is_json(x) & x.rlike(r"""^\s*\{.*:\s*\[[^\]]*\{[^}]*"text"\s*:\s*\""""))).alias("nested_lines"),
        F.struct(*[found(rf'"role"\s*:\s*"{r}"').alias(r) for r in ("user", "assistant", "system")], found('"mapping"').alias("mapping")).alias("roles"),
        ((count(first, ",") >= 2) & F.forall(F.slice("ls", 1, 10), lambda x: count(x, ",") == count(first, ","))).alias("csv_like"), (count(first, ",") + 1).alias("csv_columns"),
        (count(first, "\t") >= 2).alias("tsv_like"), many(r"^[a-zA-Z_][\w-]*\s*:").alias("yaml_keys"), share(many(r"^\s{2,}"), n).alias("indented_rate"),
        share(many(stamp), F.least(n, F.lit(200))).alias("stamp_rate"), many(r"^#{1,6}\s+").alias("headings"), F.transform(separators, lambda x: x["separator"]).alias("separators"),
        whole.alias("json_valid"), root.alias("json_root"))


# The keys of a card file in their order, and its schema's number.
KEYS = ("id", "type", "title", "subject", "predicate", "value", "status", "confidence", "importance", "valid_from", "valid_to", "recorded_at", "ended_at", "source", "links", "tags", "aliases", "hits", "last_hit", "supersedes", "superseded_by", "review_after", "schema")
SCHEMA = "1"


def _shown(cards: DataFrame, key: str) -> Column:
    """A key's value as a card file has it: texts in quotes, lists in brackets, times to the second."""
    kind = cards.schema[key].dataType.simpleString() if key in cards.columns else None
    if kind is None:
        return F.lit(SCHEMA) if key == "schema" else F.lit(None).cast("string")
    x = F.col(key)
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    if kind.startswith("timestamp"):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    return quoted(x) if kind == "string" else x.cast("string")


def rendered(cards: DataFrame) -> DataFrame:
    """(path, text): each card as a front-matter file with the keys that it has values for."""
    lines = [F.concat(F.lit(f"{k}: "), _shown(cards, k)) for k in KEYS]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    return cards.select(F.concat(F.col("type"), F.lit("/"), F.col("id"), F.lit(".md")).alias("path"), text.alias("text"))


class ReadOnly(RuntimeError):
    """A sink was asked to write in trial mode."""


def write_cards(cards: DataFrame, path: str, mode: str = "write") -> None:
    """Cards as Parquet by type; refuses in trial mode."""
    if mode == "trial":
        raise ReadOnly("trial mode does not write")
    cards.write.mode("overwrite").partitionBy("type").parquet(path)
