"""Text to ordered records, records to chunks within a budget."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import text as T
from slotwise.operators import nested
from slotwise.operators.agent import recipe_problem
from slotwise.operators.ordered import MAP, chained, kept_apart, running

# What begins a record in Markdown, logs and YAML, and from where a paragraph is cut by sentences.
HEADING = r"^#{1,3}\s+"
STAMP = r"^\s*[\[(]?(\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}|\d{4}[-/]\d{2}[-/]\d{2}|\d{2}:\d{2}:\d{2})"
YAML_KEY = r"^(\[[^\]]+\]|[A-Za-z_][\w.-]*\s*:)"
LONGEST_BLOCK = 4000
# What begins a turn and what separates records where a recipe doesn't say; the speaker of what stands before the first marked turn.
MARKERS, SEPARATOR = "User:|Assistant:|用户:|助手:|Human:|AI:", "\n---\n"
UNMARKED = "(未标注)"
META = "file-meta"
# Characters and records of a chunk.
BUDGET, MOST_RECORDS = 6000, 40
# Fixed value: what follows a text that was cut off.
CUT_OFF = "\n\n[内容超长，已截断]"
#: Rows of a CSV text; line breaks in quotes don't end a row, and a lone quote is text.
CSV_ROW = r'(?:[^"\r\n]++|"[^"]*+"|")++'


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _kept(parts: Column) -> Column:
    """Parts trimmed, without the blank ones."""
    return F.filter(F.transform(parts, lambda x: T.trimmed(x)), lambda x: x != "")


def _numbered(texts: DataFrame, parts: Column, kind: str) -> DataFrame:
    """Records of texts (source, text) from an array of parts: trimmed, without the blank ones, numbered from 0.

    All of a text's records are made in its row, so nothing is shuffled.
    """
    return texts.select("source", F.posexplode(_kept(parts)).alias("seq", "text")).select("source", "seq", F.lit(kind).alias("kind"), "text", F.length("text").alias("chars"))


def by_pieces(texts: DataFrame, pattern: str, kind: str) -> DataFrame:
    """Records between matches of a pattern, of texts (source, text)."""
    return _numbered(texts, F.split("text", pattern, -1), kind)


def by_lines(texts: DataFrame) -> DataFrame:
    return by_pieces(texts, "\r?\n", "line")


def by_blank_lines(texts: DataFrame) -> DataFrame:
    return by_pieces(texts, r"\n\s*\n", "paragraph")


def literally(text: Column) -> Column:
    """A pattern for the text itself."""
    return F.regexp_replace(text, r"([\\\[\]{}()*+?.^$|&~#-])", r"\\$1")


def by_separator(texts: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    return _numbered(texts, F.split("text", literally(F.lit(separator)), -1), "block")


def whole(texts: DataFrame) -> DataFrame:
    return texts.select("source", F.lit(0).alias("seq"), F.lit("whole").alias("kind"), "text", F.length("text").alias("chars"))


def _refilled(sentences: Column) -> Column:
    """Sentences put together again up to the longest block; one that is longer stays whole."""
    zero = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a, s):
        full = (a["now"] != "") & (F.length(a["now"]) + F.length(s) > LONGEST_BLOCK)
        return F.struct(F.when(full, s).otherwise(F.concat(a["now"], s)).alias("now"), F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"))

    return F.aggregate(sentences, zero, step, lambda a: F.concat(a["done"], F.array(a["now"])))


def sentence_parts(text: Column) -> Column:
    return F.flatten(F.transform(F.split(text, r"\n\s*\n", -1), lambda b: F.when(F.length(b) > LONGEST_BLOCK, _refilled(F.split(b, r"(?<=[。！？.!?;；\n])"))).otherwise(F.array(b))))


def by_sentences(texts: DataFrame) -> DataFrame:
    """Paragraphs; long ones cut after sentence marks and refilled."""
    return _numbered(texts, sentence_parts(F.col("text")), "text")


def island_parts(text: Column, starts: Callable[[Column], Column], head: Callable[[Column], Column], body: Callable[[Column, Column], Column] | None = None) -> Column:
    """Runs (pos, last, section, text) of a text's lines that begin with a line for which `starts` holds.

    The numbers of those lines are an array; a run is a slice between two of
    them, and what stands before the first is one too.
    """

    def firsts(ls):
        at = F.filter(F.transform(ls, lambda x, i: F.when(starts(x), i)), lambda i: i.isNotNull())
        return let(at, lambda a: F.when(F.get(a, F.lit(0)) == 0, a).otherwise(F.concat(F.array(F.lit(0)), a)))

    def runs(ls, fs):
        def run(i, k):
            first, end = F.get(ls, i), F.coalesce(F.get(fs, k + 1), F.size(ls))
            own = F.array_join(F.slice(ls, i + 1, end - i), "\n")
            said = T.trimmed(own) if body is None else body(first, F.array_join(F.slice(ls, i + 2, end - i - 1), "\n"))
            return F.struct(i.alias("pos"), (end - 1).alias("last"), F.when(starts(first), head(first)).alias("section"), said.alias("text"))

        return F.filter(F.transform(fs, run), lambda r: r["text"] != "")

    return let(F.split(text, "\r?\n", -1), lambda ls: let(firsts(ls), lambda fs: runs(ls, fs)))


def islands(texts: DataFrame, rule: tuple[Callable[[Column], Column], Callable[[Column], Column]], kind: str) -> DataFrame:
    """Records of texts (source, text) by a rule: what begins one, and what of its first line is its section."""
    out = texts.select("source", F.posexplode(island_parts(F.col("text"), *rule)).alias("seq", "r")).select("source", "seq", "r.*")
    return out.select("source", "seq", F.lit(kind).alias("kind"), F.format_string("L%d-%d", F.col("pos") + 1, F.col("last") + 1).alias("locator"), "section", "text", F.length("text").alias("chars"))


def turn_parts(text: Column, markers: Column) -> Column:
    """Turns (pos, last, section, text) of a text: a line that begins with a marker begins one.

    markers: what may begin a turn, between bars.  A turn's text is its speaker,
    which is the marker as it stands there, and below it what it says; what
    stands before the first turn is one of its own.  Turns of blanks are none.
    """
    given = F.filter(F.transform(F.split(markers, r"\|"), lambda m: T.trimmed(m)), lambda m: m != "")
    rule = F.concat(F.lit("(?i)^("), F.array_join(F.transform(given, literally), "|"), F.lit(r")\s*[:：]?\s*"))
    group = lambda x, r: F.call_function("regexp_extract", x, r, F.lit(1))

    def parts(r):
        starts = lambda x: F.rlike(T.trimmed(x), r)

        def said(first, rest):
            rest_of = F.when(starts(first), F.call_function("regexp_replace", T.trimmed(first), r, F.lit(""))).otherwise(first)
            words = T.trimmed(F.concat(rest_of, F.lit("\n"), rest))
            return F.when(words == "", "").otherwise(F.concat(F.when(starts(first), group(T.trimmed(first), r)).otherwise(UNMARKED), F.lit(":\n"), words))

        return island_parts(text, starts, lambda x: group(T.trimmed(x), r), said)

    return let(rule, parts)


#: What begins a record, and what of its first line is its section.
RULES = {
    "markdown": (lambda x: x.rlike(HEADING), lambda x: F.regexp_replace(x, HEADING, "")),
    "log": (lambda x: x.rlike(STAMP), lambda x: F.regexp_extract(x, STAMP, 1)),
    "yaml": (lambda x: x.rlike(YAML_KEY), lambda x: F.substring(F.trim(F.regexp_replace(x, r"[:\s]", " ")), 1, 60)),
}


def markdown(texts: DataFrame) -> DataFrame:
    return islands(texts, RULES["markdown"], "markdown")


def log_lines(texts: DataFrame) -> DataFrame:
    return islands(texts, RULES["log"], "log")


def yaml_blocks(texts: DataFrame) -> DataFrame:
    return islands(texts, RULES["yaml"], "yaml")


def turns(texts: DataFrame, markers: str = MARKERS) -> DataFrame:
    """A record a turn, its speaker in front of what it says; a line that begins with one of the markers begins one."""
    out = texts.select("source", F.posexplode(turn_parts(F.col("text"), F.lit(markers))).alias("seq", "r")).select("source", "seq", "r.*")
    return out.select("source", "seq", F.lit("conversation").alias("kind"), F.format_string("L%d-%d", F.col("pos") + 1, F.col("last") + 1).alias("locator"), F.coalesce("section", F.lit(UNMARKED)).alias("section"), "text", F.length("text").alias("chars"))


def csv_parts(text: Column) -> Column:
    """A text a row, rendered "name: value" by the header; the delimiter is the header's most frequent one.

    Cells beyond the header are called colN; those below an empty name are left out.
    """

    def rendered(rows):
        head = F.get(rows, F.lit(0))
        counted = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(d)))).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate((",", "\t", ";", "|"))]
        rule = F.concat(F.lit(r"\Q"), F.greatest(*counted)["d"], F.lit(r'\E(?=(?:[^"]*"[^"]*")*[^"]*$)'))

        def shown(rule, names):
            name = lambda i: F.when(i < F.size(names), F.nullif(F.get(names, i), F.lit(""))).otherwise(F.concat(F.lit("col"), (i + 1).cast("string")))
            value = lambda c, i: F.when(c != "", F.concat(name(i), F.lit(": "), c))
            return F.transform(F.filter(rows, lambda line, i: (i > 0) & (T.trimmed(line) != "")), lambda line: F.array_join(F.filter(F.transform(cells(line, rule), value), lambda x: x.isNotNull()), "\n"))

        return let(rule, lambda r: let(cells(head, r), lambda names: shown(r, names)))

    cells = lambda line, rule: F.transform(F.split(line, rule, -1), lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"')))
    return let(F.regexp_extract_all(text, F.lit(CSV_ROW), F.lit(0)), rendered)


def csv_rows(texts: DataFrame) -> DataFrame:
    """A record a row, rendered by the header."""
    return _numbered(texts, csv_parts(F.col("text")), "csv")


def _nested(split):
    """A splitter of JSON texts as one of this module."""

    def run(texts: DataFrame) -> DataFrame:
        return split(texts).select("source", F.col("pos").alias("seq"), "kind", "locator", "text", F.length("text").alias("chars"))

    return run


json_walk, json_lines, json_array, jsonl_by_recipe = map(_nested, (nested.json_walk, nested.json_lines, nested.json_array, nested.lines_by_recipe))

def _texts_of(rule: str) -> Callable[[Column], Column]:
    return lambda t: F.transform(island_parts(t, *RULES[rule]), lambda r: r["text"])


def _own(separator: Column, default: str) -> Column:
    """A recipe's separator; none and an empty one mean the default."""
    return F.coalesce(F.nullif(separator, F.lit("")), F.lit(default))


#: Splitters as (kind, texts of the records of a text), some of them by a recipe's separator, and those of JSON as functions of texts.
BY_SEPARATOR = {
    "conversation": ("conversation", lambda t: F.transform(turn_parts(t, _own(F.col("separator"), MARKERS)), lambda r: r["text"])),
    "record_separator": ("block", lambda t: _kept(F.split(t, literally(_own(F.col("separator"), SEPARATOR)), -1))),
}
PARTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "lines": ("line", lambda t: _kept(F.split(t, "\r?\n", -1))),
    "markdown": ("markdown", _texts_of("markdown")), "yaml": ("yaml", _texts_of("yaml")), "csv": ("csv", lambda t: _kept(csv_parts(t))), "log": ("log", _texts_of("log")),
    "blank_line": ("paragraph", lambda t: _kept(F.split(t, r"\n\s*\n", -1))), "whole": ("whole", lambda t: F.array(t)), "text": ("text", lambda t: _kept(sentence_parts(t))),
}
STRATEGIES = {**{k: v for k, v in PARTS.items() if k != "text"}, **BY_SEPARATOR, "jsonl": jsonl_by_recipe, "json_array": json_array}
# The paths that a recipe without fields takes.
DEFAULT_FIELDS = {"jsonl": {"角色": "role", "内容": "content[].text"}, "json_array": {"角色": "role", "内容": "content"}}
#: Splitters by the sniffed format; any other text is cut at blank lines and sentences.
BY_FORMAT = {**{k: PARTS[k] for k in ("markdown", "log", "yaml", "csv", "text")}, "json": json_walk, "jsonl": json_lines}
FIELDS = ("source", "seq", "kind", "text", "chars")


@lru_cache(maxsize=64)
def _built(jvm: int, parts: Callable[[Column], Column]) -> Column:
    """A splitter's expression over the column text, put together once for a JVM: it takes hundreds of calls to it."""
    return parts(F.col("text"))


def _dispatched(texts: DataFrame, by: str, branches: dict, other: str, marked: tuple[str, ...] = ()) -> DataFrame:
    """Each text through the splitter that column `by` names; an unknown name means `other`.

    All native splitters share one pass over the texts, whose expression the
    name chooses; those of JSON take a pass each over theirs.  With columns to
    mark texts by, these come along in a row of number -1 for each text, whose
    own text is the beginning of one that gave no record, or may have given none.
    """
    named = texts.withColumn(by, F.when(F.col(by).isin(*branches), F.col(by)).otherwise(other))
    native = {k: v for k, v in branches.items() if isinstance(v, tuple)}
    parts, kind = F.lit(None), F.lit(None)
    for name, (what, f) in native.items():
        parts, kind = F.when(F.col(by) == name, _built(id(SparkContext._jvm), f)).otherwise(parts), F.when(F.col(by) == name, what).otherwise(kind)
    kept = F.substring("text", 1, LONGEST_BLOCK)
    if marked:
        parts = let(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.concat(F.array(F.when(F.size(p) == 0, kept).otherwise("")), p))
    place = F.col("_at") - 1 if marked else F.col("_at")
    out = named.where(F.col(by).isin(*native)).select("source", kind.alias("kind"), F.posexplode(parts).alias("_at", "text"), *marked).select("source", place.alias("seq"), "kind", "text", F.length("text").alias("chars"), *marked)
    if marked:
        out = out.unionByName(named.where(~F.col(by).isin(*native)).select("source", F.lit(-1).alias("seq"), F.lit(None).cast("string").alias("kind"), kept.alias("text"), F.length(kept).alias("chars"), *marked))
    for name, split in branches.items():
        if name not in native:
            out = out.unionByName(split(named.where(F.col(by) == name)).select(*FIELDS), allowMissingColumns=True)
    return out


def _noise() -> Column:
    return F.length(F.regexp_replace("text", r"(?U)[\s\p{P}]", "")) == 0


def _with_recipe(texts: DataFrame) -> DataFrame:
    """Columns fields, meta and separator, filled with defaults where a recipe has none."""
    default = F.when(F.col("strategy") == "jsonl", F.create_map(*[F.lit(x) for kv in DEFAULT_FIELDS["jsonl"].items() for x in kv])).when(
        F.col("strategy") == "json_array", F.create_map(*[F.lit(x) for kv in DEFAULT_FIELDS["json_array"].items() for x in kv]))
    fields = F.coalesce("fields", default) if "fields" in texts.columns else default
    meta = F.coalesce("meta", F.array().cast("array<string>")) if "meta" in texts.columns else F.array().cast("array<string>")
    separator = F.col("separator").cast("string") if "separator" in texts.columns else F.lit(None).cast("string")
    return texts.select("source", "text", "strategy", fields.alias("fields"), meta.alias("meta"), separator.alias("separator"))


def by_recipe(texts: DataFrame) -> DataFrame:
    """Records of texts (source, text, strategy, and optionally fields, meta, separator); an unknown strategy keeps the text whole."""
    return _dispatched(_with_recipe(texts), "strategy", STRATEGIES, "whole").where(~_noise())


def recipe_warnings(texts: DataFrame) -> DataFrame:
    """(source, warning, n): unknown strategies, records without words, texts without records."""
    cut = _dispatched(_with_recipe(texts), "strategy", STRATEGIES, "whole")
    n = cut.groupBy("source").agg(F.count_if(_noise()).alias("noise"), F.count("*").alias("n"))
    known = F.coalesce(F.col("strategy").isin(*STRATEGIES), F.lit(False))
    all_ = texts.select("source", known.alias("known")).join(n, "source", "left")
    said = [F.when(~F.col("known"), F.struct(F.lit("unknown_strategy").alias("warning"), F.lit(1).cast("long").alias("n"))),
            F.when(F.col("noise") > 0, F.struct(F.lit("noise_dropped").alias("warning"), F.col("noise").alias("n"))),
            F.when(F.coalesce("n", F.lit(0)) == 0, F.struct(F.lit("no_records").alias("warning"), F.lit(0).cast("long").alias("n")))]
    return all_.select("source", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("w")).select("source", "w.*")


def by_rules(texts: DataFrame) -> DataFrame:
    """Records of texts (source, text, format) by format, behind a header record that says what the file is.

    A text that gives no record is kept whole up to 4000 characters.  CSV
    without any delimiter in its first line is cut like other text.
    """
    first = F.get(F.filter(F.split("text", "\r?\n"), lambda x: T.trimmed(x) != ""), F.lit(0))
    how = F.when((F.col("format") == "csv") & ~F.coalesce(first.rlike(r"[,\t;|]"), F.lit(True)), "text").otherwise(F.col("format"))
    # used for the counts, the records and the headers: each text is read once
    read = texts.select("source", "text", how.alias("format"), F.col("format").alias("said"), (F.trim("text") != "").alias("filled"))
    every = kept_apart(_dispatched(read, "format", BY_FORMAT, "text", ("said", "filled")))
    cut = every.where("seq >= 0").select(*FIELDS)
    n = cut.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n"))
    own = every.where("seq < 0").join(n, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bare = own.where("n = 0 and filled").select("source", F.lit(0).alias("seq"), F.lit("text-whole").alias("kind"), "text", "chars")
    said = F.concat_ws("\n", F.concat(F.lit("file: "), F.col("source").cast("string")), F.concat(F.lit("format: "), F.coalesce("said", F.lit("text"))),
                       F.concat(F.lit("records: "), F.when((F.col("n") == 0) & F.col("filled"), 1).otherwise(F.col("n")).cast("string")))
    head = own.select("source", F.lit(0).alias("seq"), F.lit(META).alias("kind"), said.alias("text"), F.length(said).alias("chars"))
    later = cut.unionByName(bare).withColumn("seq", F.col("seq") + 1)
    return head.unionByName(later)


def of_cards(cards: DataFrame) -> DataFrame:
    """A record a card, so that cards can be extracted again."""
    opt = lambda c, label: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    lists = [F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", "))) for c, label in (("tags", "tags: "), ("aliases", "aliases: ")) if c in cards.columns]
    text = F.concat_ws("\n", F.concat(F.lit("[card "), F.col("id"), F.lit("]")), opt("type", "type: "), opt("title", "title: "), F.concat(F.lit("slot: "), F.col("subject"), F.lit("::"), F.col("predicate")),
                       opt("value", "value: "), F.when(F.col("status") != "active", F.concat(F.lit("status: "), F.col("status"))), *lists, opt("body", "body:\n"))
    return cards.select(F.col("id").alias("source"), F.lit(0).alias("seq"), F.lit("card").alias("kind"), text.alias("text"), F.length(text).alias("chars"))


def sliced(records: DataFrame, budget: int) -> DataFrame:
    """Records longer than the budget cut into windows of 85 % of it; header records stay whole.

    A window's kind ends in -part, and its locator says which of how many it is.
    """
    size = max(1, int(budget * 0.85))
    long = (F.col("chars") > budget) & (F.col("kind") != META) if "kind" in records.columns else F.col("chars") > budget
    n = F.when(long, F.ceil(F.col("chars") / size)).otherwise(1).cast("int")
    cut = records.withColumn("_n", n).withColumn("_long", long).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    new = {"text": F.when(F.col("_long"), F.substring(F.col("text"), F.col("part") * size + 1, F.lit(size))).otherwise(F.col("text"))}
    if "kind" in records.columns:
        new["kind"] = F.when(F.col("_long"), F.concat("kind", F.lit("-part"))).otherwise(F.col("kind"))
    if "locator" in records.columns:
        new["locator"] = F.when(F.col("_long"), F.concat(F.coalesce("locator", F.lit("")), F.format_string(" (part %d/%d)", F.col("part") + 1, F.col("_n")))).otherwise(F.col("locator"))
    return cut.withColumns(new).withColumn("chars", F.length("text")).drop("_n", "_long")


def limits(budget: float | None, most: float | None) -> tuple[int, int]:
    """Usable limits: no, zero or unreadable ones mean the defaults; a budget has a floor."""
    usable = lambda x: x is not None and x == x and x > 0
    return max(64, int(budget)) if usable(budget) else BUDGET, int(most) if usable(most) else MOST_RECORDS


#: Records that a block of the packing holds, at least.
BLOCK = 1 << 20


def successors(cost: np.ndarray, alone: np.ndarray, first: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For each record, where the chunk after one that begins with it begins, next-fit.

    A chunk ends before the record that would not fit, which sorted prefix sums
    show, before one that stands alone or is a source's first, behind one that
    stands alone, and after `most` records.
    """
    n = len(cost)
    upto = np.cumsum(cost)
    fits = np.searchsorted(upto, upto - cost + budget, "right")
    stops = np.flatnonzero(first | alone | np.r_[False, alone[:-1]]) if n else np.zeros(0, np.int64)
    stop = np.r_[stops, n][np.searchsorted(stops, np.arange(n), "right")]
    return np.maximum(np.minimum(np.minimum(fits, stop), np.arange(n) + most), np.arange(n) + 1)


def landings(after: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(place at or behind `end` that the chunks from each place lead to, how many chunks begin before it), by pointer doubling."""
    at = np.r_[np.minimum(after[:end], len(after)), np.arange(end, len(after) + 1)]
    n = (np.arange(len(at)) < end).astype(np.int64)
    while (at[:end] < end).any():
        n, at = n + n[at], at[at]
    return at, n


def packed(records: DataFrame, budget: float | None = BUDGET, most: float | None = MOST_RECORDS) -> DataFrame:
    """(source, seq, part, chunk): next-fit packing in order; header records and windows of long records stay alone.

    However many records a source has, a task holds the sizes of a block of them.
    """
    budget, most = limits(budget, most)
    return _packed(sliced(records, budget), records, budget, most)


def _packed(own: DataFrame, records: DataFrame, budget: int, most: int) -> DataFrame:
    """The records of all sources in order are one sequence, dealt into blocks of a fixed number of them.

    A block also sees as many of the next one's records as a chunk may have, so
    it knows for each place where it may be entered where the next block will
    be; these maps are chained.  Then a block's chunks follow from its entry.
    """
    alone = F.coalesce((F.col("kind") == META) | F.endswith("kind", F.lit("-part")), F.lit(False)) if "kind" in records.columns else F.lit(False)
    longest = max(1, min(most, budget // 2))
    size = max(BLOCK, 4 * longest)
    items = running(own.select("source", "seq", "part", (F.col("chars") + 2).cast("long").alias("cost"), alone.alias("alone")), ["source", "seq", "part"], None, "_i")
    block, place = F.expr(f"_i div {size}"), F.col("_i") % size
    # the block before sees the first records of this one, the block behind its last
    seen = F.array(block, F.when((place < longest) & (block > 0), block - 1), F.when(place == size - 1, block + 1))
    dealt = items.withColumn("b", F.explode(F.filter(seen, lambda x: x.isNotNull())))
    n = 1 + (items.agg(F.max("_i")).first()[0] or 0)
    many = n > size
    if many:
        dealt = kept_apart(dealt)

    def parts(table: pa.Table):
        table = table.sort_by("_i").combine_chunks()
        b, at = table.column("b")[0].as_py(), table.column("_i").to_numpy()
        # a source is told from its predecessor's, nulls being one
        code = table.column("source").combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.asarray(code.indices)
        first = np.r_[True, code[1:] != code[:-1]]
        low, end = np.searchsorted(at, [b * size, (b + 1) * size])
        cost, by_itself = (table.column(k).to_numpy(zero_copy_only=False)[low:] for k in ("cost", "alone"))
        first = first[low:]
        return table, low, end - low, first, successors(cost, by_itself.astype(bool), first, budget, most)

    def maps(table: pa.Table) -> pa.Table:
        table, low, end, first, after = parts(table)
        b = table.column("b")[0].as_py()
        lands, count = landings(after, end)
        firsts = np.flatnonzero(first[:end])
        reset = bool(len(firsts))
        entries = np.minimum(np.arange(longest), end)
        exits = np.minimum(lands[entries] - end, longest - 1)
        since = np.full(longest, count[firsts[-1]]) if reset else count[entries]
        return pa.table([pa.array([b], pa.int64()), pa.array([exits.tolist()], pa.list_(pa.int32())), pa.array([since.tolist()], pa.list_(pa.int64())), pa.array([reset])], ["b", "exits", "since", "reset"])

    def assigned(table: pa.Table, entry: int, before: int) -> pa.Table:
        table, low, end, first, after = parts(table)
        starts = np.zeros(end, np.int64)
        after, i = after.tolist(), entry
        while i < end:
            starts[i] = 1
            i = after[i]
        number = np.cumsum(starts) + before - 1
        # chunks are numbered from a source's first on
        firsts = np.flatnonzero(first[:end])
        if len(firsts):
            which = np.searchsorted(firsts, np.arange(end), "right") - 1
            number = np.where(which >= 0, number - number[firsts[np.maximum(which, 0)]], number)
        own = table.slice(low, end)
        return pa.table([own.column("source"), own.column("seq"), own.column("part"), pa.array(number.astype(np.int32))], ["source", "seq", "part", "chunk"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    out = f"source {kinds['source']}, seq {kinds['seq']}, part {kinds['part']}, chunk int"
    if not many:
        return dealt.groupBy("b").applyInArrow(lambda t: assigned(t, 0, 0), out)
    entries = chained(kept_apart(dealt.groupBy("b").applyInArrow(maps, MAP)), -(-n // size))

    def entered(table: pa.Table, at: pa.Table) -> pa.Table:
        return assigned(table, at.column("entry")[0].as_py(), at.column("before")[0].as_py())

    return dealt.groupBy("b").cogroup(entries.groupBy("b")).applyInArrow(entered, out)


def chunks(records: DataFrame, budget: float | None = BUDGET, most: float | None = MOST_RECORDS, cap: int | None = None) -> DataFrame:
    """(source, chunk, record_count, chars, text) with the records rendered in order, with their locators if they have any.

    chars is the sum of the records' own, and of two for each where they are
    packed; a text longer than cap is cut there and says so.
    """
    budget, most = limits(budget, most)
    cut = sliced(records, budget)
    own = cut.join(_packed(cut, records, budget, most), ["source", "seq", "part"])
    place = F.coalesce("locator", F.lit("")) if "locator" in records.columns else F.lit("")
    shown = F.concat(F.lit('<record id="'), F.col("seq").cast("string"), F.lit('" loc="'), place, F.lit('">\n'), F.col("text"), F.lit("\n</record>"))
    lone = F.coalesce((F.col("kind") == META) | F.endswith("kind", F.lit("-part")), F.lit(False)) if "kind" in records.columns else F.lit(False)
    g = own.groupBy("source", "chunk").agg(F.count("*").alias("record_count"), F.sum(F.col("chars") + F.when(lone, 0).otherwise(2)).alias("chars"), F.array_sort(F.collect_list(F.struct("seq", "part", shown.alias("t")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")
    return g.select("source", "chunk", "record_count", "chars", (text if cap is None else T.clipped(text, cap, CUT_OFF)).alias("text"))


def chunk_of(chunks_: DataFrame, which: str) -> DataFrame:
    """The chunk of a number, for digits, or of an id "source-number"."""
    if which.isdigit():
        return chunks_.where(F.col("number") == int(which))
    return chunks_.where(F.concat_ws("-", F.col("source").cast("string"), F.col("chunk").cast("string")) == which)


def record_of(records: DataFrame, source, seq: int) -> DataFrame:
    """A record by its text and number, which are the same whenever the text is split again."""
    return records.where((F.col("source") == source) & (F.col("seq") == seq))


def numbered_across(chunks_: DataFrame) -> DataFrame:
    """Chunks of many sources with one running number, by source and chunk."""
    sizes = chunks_.groupBy("source").agg((F.max("chunk") + 1).alias("n"))
    starts = running(sizes, ["source"], "n", "_b").select(F.col("source").alias("_s"), "_b")
    return chunks_.join(starts, F.col("source") == F.col("_s")).withColumn("number", F.col("_b") + F.col("chunk")).drop("_s", "_b")


def chunks_by_recipe(texts: DataFrame, budget: float | None = BUDGET) -> DataFrame:
    """Chunks of texts (source, text, format, strategy, and optionally fields, meta, separator), all numbered in one row.

    A source with a usable recipe is cut by it; one without, or with a bad one,
    by the rules of its format, its strategy being "fallback:" and the format.
    """
    usable = recipe_problem(F.col("strategy"), F.col("fields") if "fields" in texts.columns else F.create_map().cast("map<string,string>")).isNull()
    told = texts.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    cut = chunks(kept_apart(by_recipe(told.where("_ok"))), budget).join(texts.select("source", "strategy"), "source")
    rules = chunks(kept_apart(by_rules(told.where("not _ok").select("source", "text", "format"))), budget).join(texts.select("source", F.concat(F.lit("fallback:"), F.coalesce("format", F.lit("text"))).alias("strategy")), "source")
    return numbered_across(cut.unionByName(rules))


def file_stats(records: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Of each source its records, their characters and their average length; with its texts (source, text) also its lines."""
    out = records.groupBy("source").agg(F.count("*").alias("records"), F.sum("chars").alias("chars"), F.floor(F.avg("chars") + 0.5).alias("avg_chars"))
    if texts is None:
        return out
    lines = texts.select("source", F.size(F.split("text", "\r?\n", -1)).alias("lines"))
    return lines.join(out, "source", "left").select("source", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("avg_chars", F.lit(0)).alias("avg_chars"), "lines")
