"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.ordered import shared_folder

WORD = re.compile(r"\w+")
#: Odd multiplier of the polynomial hashes; any fixed odd 64-bit value does.
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


_OPENED: ContextVar[list[Workspace] | None] = ContextVar("opened", default=None)


@contextmanager
def closing_all():
    """Close every workspace that this context opens inside, at the end; what reads them must be written by then."""
    token = _OPENED.set([])
    try:
        yield
    finally:
        for ws in _OPENED.get():
            ws.close()
        _OPENED.reset(token)


class Workspace:
    """Written tables in the shared folder; they cut lineage and survive lost executors.

    What a returned DataFrame still reads stays until close(), which its caller
    may call once the rows are written elsewhere.  A workspace given another
    as `within` is closed with it.
    """

    def __init__(self, spark: SparkSession, name: str, within: Workspace | None = None):
        self.spark = spark
        self.root = f"{within.root if within else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if (held := _OPENED.get()) is not None:
            held.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Remove all tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lean(keep: int = 1 << 20) -> None:
    """Have this process give freed blocks of more than `keep` bytes back to the system at once; for the start of a task."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, keep)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 * keep)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library: memory stays with the process longer
        pass


def give_back() -> None:
    """Have this process return what it has freed to the system, small blocks too; for the driver, once it is done with texts."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory stays with the process longer
        pass


def slices(batches, column: int | str = 1, size: int = 1 << 20, rows: int = 2048, keep: int = 1 << 20):
    """(slice of an Arrow batch, its texts) of about `size` bytes of text, so that few texts are Python objects at a time."""
    lean(keep)
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(max(end, at + 1), at + rows, b.num_rows)
            part = b.slice(at, end - at)
            yield part, part.column(column).to_pylist()
            at = end


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def held_out(doc_id):
    """True for the rows that no model may learn from; false for those without an id, which have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """At most per_class (text, label) rows of each class, never of held-out rows.

    Which rows: the first by a hash of the id, so reruns agree; of several rows
    of one id that of the smallest hash of its text.  A document with
    contradictory label rows counts as the lower one; null labels, null ids and
    null texts are left out.
    """
    own = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
        .where(~held_out(F.col("doc_id")))
        .withColumn("_o", F.xxhash64("doc_id"))
    )
    ids = None
    for y in (0, 1):
        part = own.where(F.col("_y") == y).orderBy("_o", "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.select(F.col("doc_id").alias("_id"), "_y")
    # bounded: 2 * per_class ids
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return [(r["text"], r["_y"]) for r in rows]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words: maximal runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


#: Characters outside ASCII that are no part of words: spaces and punctuation.
_OTHER = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\ufe30-\ufe4f\uff00-\uff0f]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = True
_INVERSE = pow(BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, _INVERSE)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin (one bound more than texts).

    A word is a run of letters, digits and underscores, lower-cased; characters
    outside ASCII count as letters unless they are spaces or punctuation.
    """
    parts = []
    for t in texts:
        t = (t or "").lower()
        parts.append((t if t.isascii() else _OTHER.sub(" ", t)).encode("utf-8", "surrogatepass"))
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    word = _IS_WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, end = edge[::2] + 1, edge[1::2] + 1
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum(np.where(word, raw, 0).astype(np.uint64) * up[: len(raw)], dtype=np.uint64)
        out = mix((sums[end - 1] - sums[first - 1]) * down[first] + (end - first).astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return out, np.searchsorted(first, starts)


#: Characters of text that are hashed at a time.
STRETCH = 1 << 18
_BREAK = re.compile(r"[\t\n\r \u2000-\u206f\u3000-\u303f\uff00-\uff0f]")


def parted(text: str, size: int = STRETCH) -> list[str]:
    """A long text in parts of about `size` characters, cut where no word goes on."""
    out, at = [], 0
    while len(text) - at > 2 * size:
        m = _BREAK.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def hashed_texts(texts: list[str | None], size: int = STRETCH):
    """hashed_words of each text, worked out for about `size` characters at a time; long texts in parts."""
    at = 0
    while at < len(texts):
        if len(texts[at] or "") > 2 * size:
            yield np.concatenate([hashed_words([part])[0] for part in parted(texts[at], size)])
            at += 1
            continue
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or "") <= size):
            held += len(texts[end] or "")
            end += 1
        h, bounds = hashed_words(texts[at:end])
        yield from (h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingle_hashes(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words; a shorter text is one run, an empty one none."""
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * _U(BASE) + mix(h[i : i + m])
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


#: Rows from which a key counts as hot, and tasks over which the rows of a hot key are dealt.
HOT_ROWS, SALTS = 2000, 16


def to_hot(rows: DataFrame, facts: DataFrame, key: str, spread) -> DataFrame:
    """rows joined with facts (key, n, ...), a row for each key with its number n of rows; hot keys' rows are dealt by `spread`.

    A salt is part of the join key.  Facts of a hot key stand under every salt,
    and other rows' facts under salt 0; so the rows of a key that is hot have to
    be told apart first, by a left join with the hot keys, of which there are
    at most rows / HOT_ROWS.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    hot = facts.where(F.col("n") >= HOT_ROWS).select(F.col(key).alias("_hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_hot_salt"))
    told = rows.withColumn("_salt", salt).join(hot, (F.col(key) == F.col("_hot")) & (F.col("_salt") == F.col("_hot_salt")), "left")
    told = told.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.col("_salt")).otherwise(0)).drop("_hot", "_hot_salt")
    every = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= HOT_ROWS, SALTS - 1).otherwise(0))))
    return told.join(every.withColumnRenamed(key, "_key").withColumnRenamed("_salt", "_key_salt"), (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_key_salt"))).drop("_key", "_salt", "_key_salt")


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every id in edges (a, b); comp is the smallest id that links reach.

    Alternating large-star and small-star steps: every node's neighbours move
    to the smallest of them.  A step is an aggregation of minima and a join,
    so that no node's neighbours are gathered; each round is written out.  While
    some node has HOT_ROWS neighbours, the rows of such are dealt over SALTS
    tasks in the join; else that is one merge, without a table for the driver
    to hand out in each of its many rounds.
    """
    step = ws.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")

    def told(rows: DataFrame, low: DataFrame) -> DataFrame:
        if most >= HOT_ROWS:
            return to_hot(rows, low, "u", F.col("v"))
        return rows.join(low.withColumnRenamed("u", "_key").hint("merge"), F.col("u") == F.col("_key")).drop("_key")

    before, n = None, 0
    while True:
        # order-independent state of the graph; the first half of a round leaves no node with more neighbours
        hashed = step.select("u", F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")).union(step.select("v", F.lit(0).cast("decimal(38,0)")))
        *state, most = hashed.groupBy("u").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if state == before or not state[0]:
            break
        before = state
        both = step.union(step.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = told(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = told(large, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", "m")).where("u <> v").distinct()
        n += 1
        step = ws.put(small, f"{name}-{n}")
        ws.drop(f"{name}-{n - 1}")
    return step.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(step.select(F.col("v"), F.col("v")).distinct())
