"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation, learned so that the signs of rotated vectors lose little, gives each
vector a binary code.  Codes are cut into blocks, each a table; a vector stands
in a table under its block's value and looks there also under the values that
come from flipping coordinates so small that a near vector may have the other
sign.  Pairs that meet and whose whole codes are near are compared where they
meet, by 8 bits a coordinate with known errors; those for which these errors
leave it open are compared by cosine in double precision on the vectors.  Only
these pairs are ever rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Workspace, connected_components, read, to_hot

LEAST = 0.95
#: Vectors, by a hash of their ids, that the rotation is learned from.
FIT_ROWS = 8000
STEPS = 40
BLOCK_BITS = 16
#: Largest sum of squares of the coordinates that a lookup flips, in mean squares of the noise
#: that two vectors at the least similarity differ by in one coordinate.
FLIPS = 3.6
#: Deviations above what the least similarity gives by which the bits may number in which codes of a pair differ.
DEVIATIONS = 7.0
#: Vectors of a table entry from which it is dealt into blocks.
BLOCK = 4096
#: Vectors of 64 coordinates that stand in a piece of a table, about; and vectors that a task holds links of before it hands them on.
HELD = 1 << 17
#: Vectors whose lookups are listed at a time.
CHUNK = 256


def rotation(x: np.ndarray, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, orthogonal matrix) that makes the signs of (x - mean) @ matrix balanced and faithful."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    v = x - mean
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))[0]
    for _ in range(steps if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, r


def unit(raw: list[list[float]]) -> np.ndarray:
    x = np.array(raw, np.float64).reshape(len(raw), -1)
    # by the largest component first: squares of very large or small ones leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def radius(bits: int, least: float) -> int:
    """In how many of the bits the codes of vectors of at least this cosine may differ."""
    p = math.acos(least) / math.pi
    return min(bits, math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p))))


def flips_of(cost: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, mask) of all sets of coordinates whose costs, whole numbers, sum to at most the row's limit."""
    row, mask, total = np.arange(len(cost)), np.zeros(len(cost), np.int32), np.zeros(len(cost), np.int64)
    for i in range(cost.shape[1]):
        more = total + cost[row, i]
        fit = np.flatnonzero(more <= limit[row])
        row, mask, total = np.r_[row, row[fit]], np.r_[mask, mask[fit] | (1 << i)], np.r_[total, more[fit]]
    return row, mask


def coded(raw: list[list[float]], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, shift, error) of vectors of one dimension: rotated ones are (q + 1/2) * scale but for an error of that length.

    q has 8 bits a coordinate and the signs of the code; the products of two
    rotated vectors and of the vectors themselves differ by their shifts.
    """
    mean, r = model
    x = unit(raw)
    z = (x - mean) @ r
    scale = np.maximum(np.abs(z).max(axis=1) / 127.5, 1e-30)
    q = np.clip(np.floor(z / scale[:, None]), -128, 127).astype(np.int8)
    error = np.linalg.norm(z - (q + 0.5) * scale[:, None], axis=1)
    return q, scale, x @ mean - mean @ mean / 2, error


def costs(q: np.ndarray) -> np.ndarray:
    """What it takes to flip each coordinate: four times its square, in units of the scale's."""
    return (2 * q.astype(np.int64) + 1) ** 2


def limits(scale: np.ndarray, d: int, least: float) -> np.ndarray:
    """The largest sum of costs that a lookup flips."""
    return np.floor(FLIPS * (2 - 2 * least) / d * 4 / scale**2).clip(max=2.0**60).astype(np.int64)


def tables(d: int) -> list[slice]:
    return [slice(k, min(d, k + BLOCK_BITS)) for k in range(0, d, BLOCK_BITS)]


def entries(q: np.ndarray, part: slice) -> np.ndarray:
    """Under which value each vector stands in a table."""
    return (q[:, part] >= 0) @ (1 << np.arange(part.stop - part.start))


def full_entries(reps: DataFrame, model: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """How many blocks of BLOCK vectors the fuller table entries have, by key; there are at most a few for BLOCK vectors."""

    def run(batches):
        for b in batches:
            raw = b.column(0).to_pylist()
            sizes = np.array([len(v) for v in raw])
            for d in np.unique(sizes).tolist():
                q = coded([raw[i] for i in np.flatnonzero(sizes == d)], model.get(d) or rotation(np.zeros((0, d))))[0]
                for k, part in enumerate(tables(d)):
                    value, n = np.unique(entries(q, part), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((d << 24) | (k << 16) | value, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    n = reps.select("embedding").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    return {r["key"]: -(-r["n"] // BLOCK) for r in n.collect()}


HOME, LOOKS = 1, 2


def pieces(reps: DataFrame, model: dict[int, tuple[np.ndarray, np.ndarray]], least: float, bits: int, full: dict[int, int]) -> DataFrame:
    """(piece, p, q, side, rep, copies, code, scale, shift, error) rows: where each vector stands and where it looks.

    A piece is the part of a table whose entries agree in the first `bits`
    coordinates; a vector is a row in its own and in those which its flips of
    these lead to.  A full entry is pieces of its own, one for each pair of
    its blocks.  Vectors of one dimension meet only each other.
    """

    def run(batches):
        for b in batches:
            ids, copies, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            sizes = np.array([len(v) for v in raw])
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                q, scale, shift, error = coded([raw[i] for i in own], model.get(d) or rotation(np.zeros((0, d))))
                cost, limit = costs(q), limits(scale, d, least)
                code = [x.tobytes() for x in q]
                for k, part in enumerate(tables(d)):
                    table, value = (d << 24) | (k << 16), entries(q, part)
                    at_full = np.array([int(v) | table in full for v in value])
                    n, mask = flips_of(cost[:, part][:, :bits], limit)
                    low = (1 << bits) - 1
                    rows = [(n, table | ((value[n] ^ mask) & low), np.full(len(n), -1), np.full(len(n), -1), LOOKS + HOME * ((mask == 0) & ~at_full[n]))]
                    here = np.array([x & 0xFFFF for x in full if x >> 16 == table >> 16], np.int64)
                    for at in range(0, len(q) if len(here) else 0, CHUNK):
                        n, mask = flips_of(cost[at : at + CHUNK, part], limit[at : at + CHUNK])
                        n += at
                        hit = np.isin(value[n] ^ mask, here)
                        for i, v, m in zip(n[hit].tolist(), (value[n] ^ mask)[hit].tolist(), mask[hit].tolist(), strict=True):
                            blocks = full[table | v]
                            mine, every = np.full(blocks, hash((int(ids[own[i]]), 7)) % blocks), np.arange(blocks)
                            rows.append((np.full(blocks, i), np.full(blocks, table | v), every, mine, np.full(blocks, LOOKS)))
                            if m == 0:
                                rows.append((np.full(blocks, i), np.full(blocks, table | v), mine, every, np.full(blocks, HOME)))
                    n, piece, p, o, side = (np.concatenate(c) for c in zip(*rows, strict=True))
                    for at in range(0, len(n), 1 << 15):
                        x = slice(at, at + (1 << 15))
                        i = n[x]
                        cols = [pa.array(piece[x], pa.int64()), pa.array(p[x], pa.int32()), pa.array(o[x], pa.int32()), pa.array(side[x], pa.int32()), pa.array(ids[own[i]], pa.int64()), pa.array(copies[own[i]], pa.int64()),
                                pa.array([code[j] for j in i.tolist()], pa.binary()), pa.array(scale[i]), pa.array(shift[i]), pa.array(error[i])]
                        yield pa.RecordBatch.from_arrays(cols, ["piece", "p", "q", "side", "rep", "copies", "code", "scale", "shift", "error"])

    return reps.select("rep", "copies", "embedding").mapInArrow(run, "piece long, p int, q int, side int, rep long, copies long, code binary, scale double, shift double, error double")


class Joined:
    """Which of the numbers up to n are linked, each under the smallest that it reaches."""

    def __init__(self, n: int) -> None:
        self.low = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        p, q = self.low[a], self.low[b]
        apart = p != q
        if not apart.any():
            return
        low = self.low
        for x, y in np.unique(np.stack([p[apart], q[apart]], axis=1), axis=0).tolist():
            while (up := int(low[x])) != x:
                x = up
            while (up := int(low[y])) != y:
                y = up
            low[max(x, y)] = min(x, y)
        while True:
            further = low[low]
            if (further == low).all():
                break
            low = further
        self.low = low


def met(table: pa.Table, bits: int, least: float) -> pa.Table:
    """(a, b, others) of one piece: degrees of vectors (b null), links to the smallest that each reaches (others 0), pairs left open (others null).

    A vector looks under all its flips that lie in the piece; what it meets
    there and is near by the codes is compared by the 8-bit coordinates, whose
    errors are known.  Only pairs that these leave open are handed on.  A pair
    that meets in several tables, or both ways, counts where it meets first.
    """
    table = table.combine_chunks()
    col = {c: table.column(c).to_numpy() for c in ("side", "rep", "copies", "scale", "shift", "error")}
    piece, hot = table.column("piece")[0].as_py(), table.column("p")[0].as_py() >= 0
    d, k = piece >> 24, piece >> 16 & 0xFF
    parts = tables(d)
    starts = [x.start for x in parts]
    q = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(-1, d)
    bools = np.packbits(np.pad(q >= 0, ((0, 0), (0, -d % 64))), axis=1)
    words = np.ascontiguousarray(bools).view(np.uint64)
    size = np.concatenate([np.sqrt(costs(x).sum(axis=1)) for x in np.array_split(q, len(q) // 10000 + 1)]) * col["scale"] / 2
    limit, value = limits(col["scale"], d, least), entries(q, parts[k])
    far = radius(d, least)
    home, looks = np.flatnonzero(col["side"] & HOME), np.flatnonzero(col["side"] & LOOKS)
    home = home[np.argsort(value[home], kind="stable")]
    bound = np.searchsorted(value[home], np.arange((1 << BLOCK_BITS) + 1))
    names, number = np.unique(col["rep"], return_inverse=True)
    degree, joined, left = np.zeros(len(names), np.int64), Joined(len(names)), []
    kept = 0xFFFF if hot else (1 << bits) - 1
    slack = 1e-9 + d * 2.0**-22
    step = max(1, (1 << 22) // d)

    def compare(a, b):
        near = sum(np.bitwise_count(words[a, i] ^ words[b, i]).astype(np.int32) for i in range(words.shape[1])) <= far
        a, b = a[near], b[near]
        wa, wb = (2 * q[x].astype(np.float32) + 1 for x in (a, b))
        about = np.einsum("ij,ij->i", wa, wb).astype(np.float64) * col["scale"][a] * col["scale"][b] / 4 + col["shift"][a] + col["shift"][b]
        most = col["error"][a] * (size[b] + col["error"][b]) + size[a] * col["error"][b] + slack
        may = np.flatnonzero(about + most >= least)
        a, b, sure = a[may], b[may], (about - most >= least)[may]
        other = (q[a] >= 0) != (q[b] >= 0)
        there, back = (np.add.reduceat(other * costs(q[x]), starts, axis=1) <= limit[x][:, None] for x in (a, b))
        here = ((there | back).argmax(axis=1) == k) & ((col["rep"][a] < col["rep"][b]) | ~there[:, k])
        a, b, sure = a[here], b[here], sure[here]
        left.append(np.stack([col["rep"][a], col["rep"][b]], axis=1)[~sure])
        a, b = a[sure], b[sure]
        np.add.at(degree, number[a], col["copies"][b])
        np.add.at(degree, number[b], col["copies"][a])
        joined.add(number[a], number[b])

    for at in range(0, len(looks), CHUNK):
        own = looks[at : at + CHUNK]
        n, mask = flips_of(costs(q[own][:, parts[k]]), limit[own])
        under = value[own][n] ^ mask
        n, under = (x[(under & kept) == (piece & kept)] for x in (n, under))
        there = bound[under + 1] - bound[under]
        n, under, there = (x[there > 0] for x in (n, under, there))
        ends = np.cumsum(there)
        for first in range(0, int(ends[-1]) if len(ends) else 0, step):
            i = np.arange(first, min(first + step, int(ends[-1])))
            at_look = np.searchsorted(ends, i, side="right")
            a, b = home[bound[under[at_look]] + i - (ends - there)[at_look]], own[n[at_look]]
            apart = col["rep"][a] != col["rep"][b]
            compare(a[apart], b[apart])
    star, some = np.flatnonzero(joined.low != np.arange(len(names))), np.flatnonzero(degree)
    open_ = np.concatenate([np.zeros((0, 2), np.int64), *left])
    none = lambda m: pa.nulls(m, pa.int64())
    return pa.table({
        "a": pa.array(np.concatenate([names[star], names[some], open_[:, 0]]), pa.int64()),
        "b": pa.chunked_array([pa.array(names[joined.low[star]], pa.int64()), none(len(some)), pa.array(open_[:, 1], pa.int64())]),
        "others": pa.chunked_array([pa.array(np.zeros(len(star), np.int64)), pa.array(degree[some]), none(len(open_))])})


def meeting(reps: DataFrame, model: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """Rows of `met` of all pieces: parts of a table by as many of its bits as leave about HELD vectors of 64 coordinates in one."""
    n = reps.agg(F.sum(F.size("embedding").cast("double"))).first()[0] or 0
    bits = min(BLOCK_BITS, max(1, math.ceil(math.log2(max(1, n / 64 / HELD)))))
    rows = pieces(reps, model, least, bits, full_entries(reps, model))
    return rows.groupBy("piece", "p", "q").applyInArrow(lambda t: met(t, bits, least), "a long, b long, others long")


class Linked:
    """Links of a task, kept as the degrees of their ends and as links to the smallest end that each reaches.

    Tasks that see parts of one group mostly name the same smallest end, so
    that equal links of theirs become one.
    """

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.degree: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def add(self, a: np.ndarray, b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray) -> None:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        for i, n in zip(ids.tolist(), np.bincount(at, np.concatenate([copies_b, copies_a])).astype(np.int64).tolist(), strict=True):
            self.degree[i] = self.degree.get(i, 0) + n
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)

    def taken(self) -> pa.RecordBatch:
        """(a, b, others): links to smallest ends, and degrees with b null; what was held is given up."""
        star = [(x, self.top(x)) for x in list(self.root)]
        n, m = len(star), len(self.degree)
        a = [x for x, _ in star] + list(self.degree)
        b = [y for _, y in star] + [None] * m
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * n + list(self.degree.values()), pa.int64())], ["a", "b", "others"])
        self.__init__()
        return out


def reranked(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of those of pairs whose cosine, in double precision, is at least `least`: (a, b, others).

    A task gives for each vector how many others it met, and a link to the
    smallest that it reaches: two rows a vector, however many pairs a group of
    near copies has.
    """

    def run(batches):
        held = Linked()
        for x in batches:
            if x.num_rows:
                a, b = (x.column(i) for i in (2, 3))
                va, vb = (np.array(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in (a, b))
                sizes = np.array(a.value_lengths())
                cuts = np.r_[0, np.cumsum(sizes)]
                # by the largest component first: squares of very large or small ones leave the range
                va, vb = (v / np.repeat(np.maximum.reduceat(np.abs(v), cuts[:-1]), sizes) for v in (va, vb))
                dot, aa, bb = (np.add.reduceat(v, cuts[:-1]) for v in (va * vb, va * va, vb * vb))
                near = dot / np.sqrt(aa) / np.sqrt(bb) >= least
                held.add(*(x.column(i).to_numpy()[near] for i in (0, 1, 4, 5)))
                if len(held.degree) > HELD:
                    yield held.taken()
        if held.degree:
            yield held.taken()

    left = reps.select(F.col("rep").alias("a"), F.col("embedding").alias("_va"), F.col("copies").alias("_na"))
    right = reps.select(F.col("rep").alias("b"), F.col("embedding").alias("_vb"), F.col("copies").alias("_nb"))
    joined = pairs.join(left, "a").join(right, "b").where(F.size("_va") == F.size("_vb"))
    return joined.select("a", "b", "_va", "_vb", "_na", "_nb").mapInArrow(run, "a long, b long, others long")


def fit(reps: DataFrame, rows: int = FIT_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rotations by dimension, from at most `rows` vectors (the first by a hash of their ids)."""
    got = reps.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("embedding").collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(len(r[0]), []).append(r[0])
    return {d: rotation(unit(v)) for d, v in by.items()}


def links(vectors: DataFrame, ws: Workspace, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors with their representative, representatives with their number of copies, links and degrees between these)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    good = known.where(F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    # -0.0 and 0.0 group together but read differently; sha2 stands for the vector where members meet their representative
    kind = vectors.schema["embedding"].dataType.elementType
    good = good.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(kind)))
    good = ws.put(good.withColumn("digest", F.unhex(F.sha2(F.col("embedding").cast("string"), 256))), "vectors")
    reps = ws.put(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("digest").alias("digest")), "reps")
    ids = ws.put(good.select("vec_id", "digest"), "ids")
    ws.drop("vectors")
    member = ids.join(reps.select("digest", "rep", "copies"), "digest").select("vec_id", "rep", "copies")
    found = ws.put(meeting(reps, fit(reps), least), "met")
    left = reranked(found.where("others is null").select("a", "b"), reps, least)
    return member, reps, ws.put(found.where("others is not null").unionByName(left), "links")


def embedding_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null, empty or zero, or hold null or non-finite numbers,
    link with nothing; neither do vectors of different dimensions.  Rows that
    repeat a vec_id are one vector, the smallest embedding if they differ; rows
    without a vec_id link with nothing and have no component.  An empty table
    gives no rows; other columns are not read.
    """
    ws = Workspace(vectors.sparkSession, "itq")
    vectors = vectors.select("vec_id", "embedding")
    member, reps, found = links(vectors, ws, least)
    degree = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    comps = ws.put(connected_components(ws, found.where("b is not null").select("a", "b"), "comps"), "all").withColumnRenamed("id", "rep")
    own = member.join(degree, "rep", "left").join(comps, "rep", "left").select(
        F.col("vec_id").alias("_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("comp", "rep").alias("_comp"))
    out = vectors.select("vec_id").join(own, F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark, sf_dir):
    return embedding_duplicates(read(spark, sf_dir, "embeddings"))
