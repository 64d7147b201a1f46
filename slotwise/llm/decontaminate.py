"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

For every size that benchmark items have, the windows of that many runs of five
words in a document get a SimHash.  Fingerprints are cut into blocks; two that
differ in no more than RADIUS bits differ in at most FLIPS bits of some block.
A table for each block has the items under all values that near theirs, sorted
by value, so looking up every block of a window misses no item in the radius.
What is in the radius is then compared exactly: weighted Jaccard similarity of
the windows' and the items' multisets of runs.

A window without any run of any item has similarity 0 to all; those are passed
over before hashing, which loses nothing.

A text with fewer runs than an item is one window and is compared exactly with
the items that share runs with it.  An item of fewer than five words is one run
of its own length, looked up among the text's runs of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import BASE, Workspace, free_name, hashed_texts, mix, read, shingle_hashes, slices

WORDS = 5
LEAST = 0.8
BITS = 256
BLOCKS = 16
WIDTH = BITS // BLOCKS
#: Two multisets of similarity 0.8 have an angle that sets 15.2 % of the bits apart: 39 of 256,
#: 5.7 a standard deviation.  Flips in a block that tables allow for, and the largest radius for
#: which one block at least has no more of them.
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items that one pass over the documents may hold, about 45 kB of tables each; more of them take more passes.
MOST_ITEMS = 4_000
MOST_CHARS = 8_000_000
FILTER_BITS = 22
STRETCH = 1 << 13
#: Windows, and pairs of a window and an item, that are looked at together.
WINDOWS, PAIRS = 4096, 1 << 20
_U = np.uint64


def bits_of(h: np.ndarray) -> np.ndarray:
    """The BITS bits of each hash as a row of -1 and 1."""
    with np.errstate(over="ignore"):
        words = np.stack([mix(h + _U(BASE) * _U(k)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Sums of the bits' signs before each place of h; a window's is the difference of two rows."""
    sums = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(bits_of(h), axis=0, dtype=np.int32, out=sums[1:])
    return sums


def window_prints(sums: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows of that size that begin at the given places, a row of 64-bit words each."""
    return np.packbits(sums[starts + size] > sums[starts], axis=1).view(np.uint64)


def block_values(prints: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints as small numbers, a column each."""
    return np.ascontiguousarray(prints).view(np.uint16)


def near_values(width: int, flips: int) -> np.ndarray:
    """All masks of at most so many bits."""
    x = np.arange(1 << width)
    return x[np.bitwise_count(x) <= flips]


NEAR = near_values(WIDTH, FLIPS).astype(np.uint16)


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


class Blocks:
    """A table for each block of fingerprints: the items under all values near theirs, sorted by size class and value."""

    def __init__(self, prints: np.ndarray, size: np.ndarray):
        self.prints, self.tables = prints, []
        owner = np.repeat(np.arange(len(prints), dtype=np.uint16), len(NEAR))
        for own in block_values(prints).T:
            keys = ((size.astype(np.uint32) << np.uint32(WIDTH))[:, None] | (own[:, None] ^ NEAR)).ravel()
            order = np.argsort(keys, kind="stable")
            values, starts = np.unique(keys[order], return_index=True)
            self.tables.append((values, np.r_[starts, len(keys)], owner[order]))

    def looked_up(self, prints: np.ndarray, size: np.ndarray):
        """(window, item) pairs of one size class, a part at a time, of which a block is near; pairs may repeat."""
        high = size.astype(np.uint32) << np.uint32(WIDTH)
        for (values, starts, owner), own in zip(self.tables, block_values(prints).T, strict=True):
            keys = high | own
            at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
            some = np.flatnonzero(values[at] == keys)
            low = starts[at[some]]
            n = starts[at[some] + 1] - low
            ends = np.cumsum(n)
            k = 0
            while k < len(some):
                end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
                m = n[k:end]
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[k:end], m)
                yield np.repeat(some[k:end], m), owner[place].astype(np.int64)
                k = end

    def candidates(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of one size class within RADIUS bits of each other."""
        found = [np.zeros(0, np.int64)]
        for w, i in self.looked_up(prints, size):
            near = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1, dtype=np.int64) <= RADIUS
            found.append(w[near] * len(self.prints) + i[near])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))


class Tables:
    """Items of one size with their runs; the first is the index' item number `first`."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]], first: int):
        self.size, self.first, self.ids = size, first, np.array([i for i, _ in items], np.int64)
        self.runs = [np.unique(h, return_counts=True) for _, h in items]
        self.prints = np.concatenate([window_prints(bit_sums(h), size, np.zeros(1, np.int64)) for _, h in items])
        self.owners: tuple[np.ndarray, np.ndarray] | None = None

    def sharing(self, x: np.ndarray) -> list[int]:
        """The items with any of the given runs."""
        if self.owners is None:
            every = np.concatenate([a for a, _ in self.runs])
            owner = np.repeat(np.arange(len(self.runs)), [len(a) for a, _ in self.runs])
            order = np.argsort(every, kind="stable")
            self.owners = every[order], owner[order]
        every, owner = self.owners
        low, high = (np.searchsorted(every, x, side) for side in ("left", "right"))
        return sorted({int(i) for a, b in zip(low, high, strict=True) for i in owner[a:b]})

    def similarity(self, x: np.ndarray, k: int) -> float:
        """Weighted Jaccard similarity of a window's runs and those of an item."""
        a, n = self.runs[k]
        b, m = np.unique(x[member(x, a)], return_counts=True)
        both = int(np.minimum(n[np.searchsorted(a, b)], m).sum())
        return both / (len(x) + self.size - both)


class Index:
    def __init__(self, items: list[tuple[int, str | None]]):
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for (item, _), h in zip(items, hashed_texts([t for _, t in items]), strict=True):
            runs = shingle_hashes(h, WORDS)
            if 0 < len(h) < WORDS:
                self.short.setdefault(len(h), {}).setdefault(int(runs[0]), []).append(item)
            elif len(runs):
                by.setdefault(len(runs), []).append((item, runs))
        self.tables: list[Tables] = []
        for n, own in sorted(by.items()):
            self.tables.append(Tables(n, own, sum(len(t.ids) for t in self.tables)))
        if by:
            self.blocks = Blocks(np.concatenate([t.prints for t in self.tables]), np.repeat(np.arange(len(self.tables)), [len(t.ids) for t in self.tables]))
        self.runs = np.unique(np.concatenate([h for own in by.values() for _, h in own])) if by else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.runs & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def found(self, words: np.ndarray, least: float) -> dict[int, float]:
        """The items in a document, given by its words' hashes, with their best similarity."""
        h = shingle_hashes(words, WORDS)
        maybe = np.flatnonzero(self.seen[(h & _U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        hits = maybe[member(h[maybe], self.runs)]
        out: dict[int, float] = {}
        for n, own in self.short.items():
            if len(words) >= n:
                x = shingle_hashes(words, n)
                keys = np.array(sorted(own), np.uint64)
                out |= {item: 1.0 for k in set(x[member(x, keys)].tolist()) for item in own[k]}
        if not len(hits):
            return out
        longest = self.tables[-1].size
        # stretches of the text that hold all windows with a hit, none too long to hold in memory
        cuts = np.flatnonzero((np.diff(hits) > 2 * longest) | (np.diff(hits // STRETCH) > 0)) + 1
        for part in np.split(hits, cuts):
            low, high = max(0, int(part[0]) - longest), min(len(h), int(part[-1]) + longest)
            self._in_stretch(h[low:high], part - low, least, out)
        return out

    def _in_stretch(self, h: np.ndarray, hits: np.ndarray, least: float, out: dict[int, float]) -> None:
        hit = np.zeros(len(h), np.int32)
        hit[hits] = 1
        upto = np.r_[0, np.cumsum(hit)]
        sums = bit_sums(h)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # size class, start, fingerprint of windows
        n = 0
        for c, t in enumerate(self.tables):
            if len(h) < t.size:  # the stretch is the whole text
                most = len(hits)
                if most >= least * (len(h) + t.size - most):
                    for k in t.sharing(np.unique(h[hits])):
                        self._keep(t, k, t.similarity(h, k), least, out)
                continue
            starts = np.flatnonzero(upto[t.size :] > upto[: len(h) - t.size + 1])
            for at in range(0, len(starts), WINDOWS):
                own = starts[at : at + WINDOWS]
                held.append((np.full(len(own), c), own, window_prints(sums, t.size, own)))
                n += len(own)
                if n >= WINDOWS:
                    self._compare(h, upto, held, least, out)
                    held, n = [], 0
        if held:
            self._compare(h, upto, held, least, out)

    def _compare(self, h: np.ndarray, upto: np.ndarray, held, least: float, out: dict[int, float]) -> None:
        """Look windows up and compare what is near with the items, exactly."""
        c, start, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        w, i = self.blocks.candidates(prints, c)
        size = np.array([t.size for t in self.tables])[c[w]]
        # no more runs in common than hits
        most = upto[start[w] + size] - upto[start[w]]
        may = most >= least * (2 * size - most)
        for s, k, item in zip(start[w][may].tolist(), c[w][may].tolist(), i[may].tolist(), strict=True):
            t = self.tables[k]
            self._keep(t, item - t.first, t.similarity(h[s : s + t.size], item - t.first), least, out)

    @staticmethod
    def _keep(t: Tables, k: int, sim: float, least: float, out: dict[int, float]) -> None:
        item = int(t.ids[k])
        if sim >= least and sim > out.get(item, 0.0):
            out[item] = sim


def _pass(docs: DataFrame, items: list[tuple[int, str | None]], least: float, column: str) -> DataFrame:
    """docs with the found items in a new last column."""
    from pyspark.sql import types as T

    found_type = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())]))

    def run(batches):
        index = Index(items)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))
        for b, texts in slices(batches, "text"):
            found = [sorted(index.found(h, least).items()) for h in hashed_texts(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[{"item_id": i, "similarity": s} for i, s in f] for f in found], kind)], [*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, found_type)]))


def with_items(docs: DataFrame, benchmark: DataFrame, column: str = "items", least: float = LEAST, within: Workspace | None = None) -> DataFrame:
    """docs, row by row, with a new last column: (item_id, similarity) of the benchmark items in the text.

    A benchmark of more than MOST_ITEMS rows or MOST_CHARS characters takes
    several passes over the documents, which then get a key of their own; the
    rows are the same.  Rows of one item_id are one item, however they are dealt
    to passes: it has the best similarity of any of its texts.
    """
    own = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // MOST_ITEMS), -(-chars // MOST_CHARS))
    if passes == 1:
        return _pass(docs, [(r[0], r[1]) for r in own.collect()], least, column)  # bounded: MOST_ITEMS
    key, other = free_name(docs, "_row"), free_name(docs, "_found")
    ws = Workspace(docs.sparkSession, "decontaminate", within)
    keyed = ws.put(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    every = None
    for k in range(passes):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        found = _pass(keyed.select(key, "text"), [(r[0], r[1]) for r in part.collect()], least, column)  # bounded: about n / passes items
        found = ws.put(found.where(F.size(column) > 0).select(key, column), f"found-{k}")
        every = found if every is None else every.unionByName(found)
    each = every.select(key, F.explode(column).alias("_x")).groupBy(key, F.col("_x.item_id").alias("item_id")).agg(F.max("_x.similarity").alias("similarity"))
    # a document has no more entries than there are items in it
    every = each.groupBy(F.col(key).alias(other)).agg(F.array_sort(F.collect_list(F.struct("item_id", "similarity"))).alias(column))
    return keyed.join(every, F.col(key) == F.col(other), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(column, F.array().cast(every.schema[column].dataType)).alias(column))


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document: doc_id, contaminated, items (item_id, similarity) of the benchmark items in it.

    Null and empty texts, and items without words, match nothing; rows of one
    item_id are one item, found by any of its texts; an empty benchmark leaves every document clean; rows
    with repeated ids or none are marked each by its own text; other columns
    are not read; an empty table gives no rows.
    """
    found = with_items(docs.select("doc_id", "text"), benchmark, "items", least)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def op8_decontamination(spark, sf_dir):
    """Which documents hold items; the items' ids in ascending order as text, separated by commas."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["item_id"])))
    return found.select("doc_id", "contaminated", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("item_ids"))
