"""Mixing sources to target weights: blocks of words, drawn shard by shard.

The words of a source, document after document, are packed into blocks of a
fixed length.  Targets share all words by weight, none above three times its
source.  Output shards draw how many of their slots each source fills from a
multinomial over what the sources still owe, so the totals come out exactly.
A source's q-th slot holds block permutation_epoch(q mod blocks); each epoch has
a pseudorandom permutation of its own, so that all blocks are taken once before
any is taken again.  Slots and blocks meet in a join by (source, block).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.llm.common import Workspace, mix, read

BLOCK = 64  # words
WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_SLOTS = 4096
MOST_SHARDS = 1024
SEED = 20240501
#: Sources whose slots one task shares out.
SOURCES_TOGETHER = 4096
_U = np.uint64


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Permutation:
    """A pseudorandom permutation of range(n): a Feistel network, walked until it falls in range."""

    ROUNDS = 4

    def __init__(self, n: int, source: int, epoch: int, seed: int = SEED):
        self.n = n
        self.half = _U(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = _U((1 << int(self.half)) - 1)
        self.keys = mix(np.array([(seed << 20) ^ (source << 8) ^ (epoch << 3) ^ r for r in range(self.ROUNDS)], np.uint64) * _U(0x9E3779B97F4A7C15))

    def _round(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                a, b = b ^ (mix(a ^ k) & self.mask), a
            else:
                a, b = b, a ^ (mix(b ^ k) & self.mask)
        return (a << self.half) | b

    def __call__(self, i: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._round(np.asarray(i, np.uint64), back)
        while True:
            out = x >= _U(self.n)
            if not out.any():
                return x.astype(np.int64)
            x[out] = self._round(x[out], back)


@dataclass(frozen=True)
class Draw:
    """What a source gives: `slots` slots, of which the last takes only `last` words of its block."""

    sid: int
    size: int
    words: int
    slots: int
    last: int

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)


def drawn(sid: int, size: int, target: float) -> Draw:
    words = int(np.floor(target + 0.5))
    blocks = -(-size // BLOCK)
    if not words:
        return Draw(sid, size, 0, 0, 0)
    epochs, rest = divmod(words, size)
    if not rest:
        # the last slot of the last whole epoch takes its whole block
        return Draw(sid, size, words, epochs * blocks, BLOCK)
    short = size - (blocks - 1) * BLOCK
    at = int(Permutation(blocks, sid, epochs)(np.array([blocks - 1]), back=True)[0])
    before = at * BLOCK
    if rest <= before:
        n = -(-rest // BLOCK)
        last = rest - (n - 1) * BLOCK
    elif rest <= before + short:
        n, last = at + 1, rest - before
    else:
        more = rest - before - short
        n = at + 1 + -(-more // BLOCK)
        last = more - (n - at - 2) * BLOCK
    return Draw(sid, size, words, epochs * blocks + n, last)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size).

    sid ranks the sources by code point, null last.  Resharing the excess by
    weight until none is above its limit ends at min(limit, weight * level):
    the level follows from sums over the sources in the order in which they
    reach their limits.
    """
    ranked = sizes.withColumn("sid", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1).cast("double")
    ranked = ranked.withColumn("_w", weight).withColumn("_limit", (MOST * F.col("source_size")).cast("double"))
    ranked = ranked.withColumn("_at", F.col("_limit") / F.col("_w"))
    order = W.orderBy("_at", "sid")
    full = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    level = (F.sum("source_size").over(full) - (F.sum("_limit").over(upto) - F.col("_limit"))) / (F.sum("_w").over(full) - (F.sum("_w").over(upto) - F.col("_w")))
    ranked = ranked.withColumn("_level", level)
    ranked = ranked.withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "sid", "_level"))).over(full))
    return ranked.select("source", "sid", "source_size", F.least("_limit", F.col("_w") * F.coalesce(F.col("_first._level"), F.lit(0.0))).alias("target"))


def shared_out(owed: np.ndarray, wants: np.ndarray, key: tuple[int, ...]) -> np.ndarray:
    """For each shard (row) how many of its slots each party (column) fills, all in all as many as owed.

    A shard's counts are a multinomial draw over what the parties still owe;
    what exceeds that is drawn again among the others.
    """
    left, out = owed.astype(np.int64), np.zeros((len(wants), len(owed)), np.int64)
    for k, want in enumerate(wants.tolist()):
        rest = int(left.sum())
        if rest <= want:
            n = left.copy()
        else:
            rng = np.random.default_rng([*key, k])
            n = np.minimum(rng.multinomial(want, left / rest), left)
            while (lack := want - int(n.sum())) > 0:
                room = left - n
                n += np.minimum(rng.multinomial(lack, room / room.sum()), room)
        out[k], left = n, left - n
    return out


def draws(sources: DataFrame) -> DataFrame:
    """sources with words, blocks, slots and last of each one's Draw."""

    def run(batches):
        for b in batches:
            own = [drawn(*x) for x in zip(*(b.column(c).to_pylist() for c in ("sid", "source_size", "target")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("sid"), *(pa.array([getattr(d, c) for d in own], pa.int64()) for c in ("blocks", "slots", "last"))], ["sid", "blocks", "slots", "last"])

    return sources.select("sid", "source_size", "target").mapInArrow(run, "sid int, blocks long, slots long, last long")


def slots(own: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, sid, slot, block, epoch, words) of the whole mix, from draws; words: how many of the block's the slot takes at most.

    Sources are shared out in groups of about SOURCES_TOGETHER: the driver draws
    how many slots of a shard each group fills, a task for each group does the
    same for its sources.
    """
    # few sources are one group
    groups = -(-own.count() // SOURCES_TOGETHER) or 1
    own = own.withColumn("g", F.pmod("sid", F.lit(groups)))
    owed = np.zeros(groups, np.int64)
    for r in own.groupBy("g").agg(F.sum("slots").alias("n")).collect():  # a row for SOURCES_TOGETHER sources
        owed[r["g"]] = r["n"]
    total = int(owed.sum())
    per = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    wants = shared_out(owed, np.full(-(-total // per), per, np.int64), (seed,))

    def share(table: pa.Table) -> pa.Table:
        t = table.sort_by("sid")
        g, sid, blocks, n, last = (t.column(c).to_numpy() for c in ("g", "sid", "blocks", "slots", "last"))
        counts = shared_out(n, wants[:, g[0]], (seed, int(g[0]) + 1))
        first = np.cumsum(counts, axis=0) - counts
        k, i = np.nonzero(counts)
        # pieces of at most SHARD_SLOTS slots
        parts = -(-counts[k, i] // SHARD_SLOTS)
        k, i, piece = np.repeat(k, parts), np.repeat(i, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(SHARD_SLOTS, counts[k, i] - piece * SHARD_SLOTS)
        return pa.table({"shard": k.astype(np.int32), "sid": sid[i], "first": first[k, i] + piece * SHARD_SLOTS, "n": size, "blocks": blocks[i], "slots": n[i], "last": last[i]})

    plan = own.where("slots > 0").groupBy("g").applyInArrow(share, "shard int, sid int, first long, n long, blocks long, slots long, last long")

    def run(batches):
        for b in batches:
            for shard, sid, first, n, blocks, total_, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q = np.arange(first, first + n)
                epochs = q // blocks
                at = np.empty(n, np.int64)
                for epoch in np.unique(epochs).tolist():
                    mine = epochs == epoch
                    at[mine] = Permutation(blocks, sid, epoch)(q[mine] % blocks)
                words = np.where(q == total_ - 1, last, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, sid, np.int32)), pa.array(q), pa.array(at), pa.array(epochs.astype(np.int32)), pa.array(words.astype(np.int64))],
                    ["shard", "sid", "slot", "block", "epoch", "words"])

    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.repartition(parts).mapInArrow(run, "shard int, sid int, slot long, block long, epoch int, words long")


def placed(ws: Workspace, sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized (doc_id, source, size, _tie, ...) with sid, source_size, target, and offset in its source; (_part, sid, _n) is unique.

    Documents of a source stand in order of doc_id, null first, then of _tie.
    The table of sources is small enough to be broadcast, or Spark joins otherwise.
    """
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    own = sources.withColumnRenamed("source", "_source")
    joined = sized.join(own, sized["source"].eqNullSafe(own["_source"])).drop("_source")
    spread = joined.repartitionByRange(parts, "sid", "doc_id", "_tie").withColumn("_part", F.spark_partition_id())
    spread = ws.put(spread, "spread")
    w = W.partitionBy("_part", "sid").orderBy(F.col("doc_id").asc_nulls_first(), "_tie")
    within = spread.withColumn("_n", F.row_number().over(w)).withColumn("_within", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    sums = spread.groupBy("_part", "sid").agg(F.sum("size").alias("_sum"))
    base = sums.withColumn("_base", F.sum("_sum").over(W.partitionBy("sid").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_sum")).select("_part", "sid", "_base")
    return within.join(base, ["_part", "sid"]).withColumn("offset", F.col("_base") + F.col("_within")).drop("_base", "_within", "_tie")


def mixed(docs: DataFrame, ws: Workspace, kept: tuple[str, ...] = (), tie: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents placed, what the mix takes of them as (_part, sid, _n, epoch, from, to) word ranges).

    kept: further columns of the first; tie: what orders rows of one doc_id, a hash of the text if not given.
    """
    sized = docs.select("doc_id", "source", *kept, word_count(F.col("text")).alias("size"), (F.xxhash64("text") if tie is None else tie).alias("_tie"))
    sized = ws.put(sized, "sized")
    sources = ws.put(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    docs_at = ws.put(placed(ws, sized, sources), "placed")
    ws.drop("sized", "spread")
    first = F.expr(f"offset div {BLOCK}")
    # a row for each block that a document has words in
    pieces = (
        docs_at.where("size > 0").select("_part", "sid", "_n", "offset", "size", F.explode(F.sequence(first, F.expr(f"(offset + size - 1) div {BLOCK}"))).alias("block"))
        .withColumn("_from", F.greatest(F.col("offset") - F.col("block") * BLOCK, F.lit(0)))
        .withColumn("_to", F.least(F.col("offset") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK)))
    )
    filled = slots(ws.put(draws(sources), "draws")).select("sid", "block", "epoch", "words")
    # both grow with the text: no side is broadcast for the size of its packed file
    taken = pieces.hint("merge").join(filled, ["sid", "block"]).where(F.col("_from") < F.col("words")).select(
        "_part", "sid", "_n", "epoch",
        (F.col("_from") + F.col("block") * BLOCK - F.col("offset")).alias("from"),
        (F.least("_to", "words") + F.col("block") * BLOCK - F.col("offset")).alias("to"))
    return docs_at, taken


def mixing(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own, the last; repeated rows are documents of their own, and
    rows of one doc_id stand in the order of their texts' hashes, so that reruns
    agree; an empty table gives no rows; columns other than doc_id, text and
    source are not read.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    docs_at, taken = mixed(docs, ws)
    own = taken.groupBy("_part", "sid", "_n").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return docs_at.hint("merge").join(own, ["_part", "sid", "_n"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mixing(spark, sf_dir):
    return mixing(read(spark, sf_dir, "documents"))
