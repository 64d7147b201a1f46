"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is the multiset of its runs of five words.  Every unit of an
element's weight is a strip with a fixed Poisson process of darts along a rank
axis, the same in all documents that hold the unit.  Darts are thrown up to a
rank that gives the document about k ln k + 2k of them whatever its length,
and each of k coordinates keeps the earliest dart hashed to it: two documents
agree on a coordinate with the probability of their weighted Jaccard
similarity.  Bands of coordinates are join keys; every link is then verified
on the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import BASE, Workspace, connected_components, hashed_texts, mix, read, shingle_hashes, signed, slices, to_hot

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 24, 4
#: Rounds in which a bucket's members meet one member only, before all that are still apart meet.
STAR_ROUNDS = 2
#: Then larger buckets are dealt into blocks of about so many members.
BLOCK = 256
#: Rows that one group of blocks has, about.
GROUP_ROWS = 4000
#: Bytes and rows of text that signatures are worked out for together; a document has about 600 darts, however short.
SLICE, SLICE_ROWS = 1 << 19, 512
#: Agreeing coordinates, in standard deviations below what the least similarity gives, from
#: which two members of a block are held against each other; what is missed is under 1e-11.
DEVIATIONS = 7.0
_U = np.uint64


def uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1) from hashes."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def occurrences(e: np.ndarray) -> np.ndarray:
    """For each element of e: how many equal ones stand before it, in some order that only counts decide."""
    order = np.argsort(e, kind="stable")
    s = e[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(e), np.int64)
    out[order] = np.arange(len(s)) - start
    return out


def signatures(docs: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """The dart that each of k coordinates keeps, for documents given as element hashes with repeats.

    Rows of documents without elements are 0.
    """
    out = np.zeros((len(docs), k), np.uint64)
    todo = [i for i, e in enumerate(docs) if len(e)]
    units = {i: mix(docs[i] + _U(BASE) * occurrences(docs[i]).astype(np.uint64)) for i in todo}
    t = k * math.log(k) + 2 * k
    while todo:
        size = np.array([len(units[i]) for i in todo])
        unit = np.concatenate([units[i] for i in todo])
        own = np.repeat(np.arange(len(todo)), size)
        limit = (t / size)[own]
        best = np.full(len(todo) * k, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, j = np.zeros(len(unit)), 0
        while len(unit):
            h = mix(unit + _U((j + 1) * 0x632BE59BD9B4E019 % 2**64))
            rank = rank - np.log(uniform(h))
            there = rank < limit
            unit, own, limit, rank, h = unit[there], own[there], limit[there], rank[there], mix(h[there])
            at = own * k + (h % _U(k)).astype(np.int64)
            np.minimum.at(best, at, rank)
            darts.append((at, rank, h))
            j += 1
        flat = np.zeros(len(todo) * k, np.uint64)
        for at, r, h in darts:
            won = r == best[at]
            flat[at[won]] = h[won]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        rows = np.array(todo)
        out[rows[full]] = flat.reshape(-1, k)[full]
        todo = rows[~full].tolist()
        t *= 2  # a coordinate without a dart: further along the same processes
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _U(BASE)
        for r in range(rows):
            key = mix(key * _U(31) + sig[:, r::rows][:, :bands])
    return key


def elements(text: str | None) -> np.ndarray:
    return shingle_hashes(next(hashed_texts([text])), WORDS)


def units_of(e: np.ndarray) -> np.ndarray:
    """The multiset of element hashes as a sorted set: an element's n-th occurrence is one of its own.

    32 bits each: among n and m of them about n * m / 2**32 meet by chance.
    """
    return np.unique((mix(e + _U(BASE) * occurrences(e).astype(np.uint64)) >> _U(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 where both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def content_of(words: np.ndarray) -> bytes | None:
    """128 bits of a text's words; None without any."""
    if not len(words):
        return None
    with np.errstate(over="ignore"):
        x = mix(words + _U(BASE) * np.arange(1, len(words) + 1, dtype=np.uint64))
        y = mix(x ^ _U(0xD6E8FEB86659FD93))
        return signed(np.array([x.sum(dtype=np.uint64), y.sum(dtype=np.uint64)])).tobytes()


def id_kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, content, bands): a hash of the words, the join keys (null without words)."""

    def run(batches):
        for b, texts in slices(batches, size=SLICE, rows=SLICE_ROWS):
            words = list(hashed_texts(texts))
            keys = signed(band_keys(signatures([shingle_hashes(h, WORDS) for h in words])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([content_of(h) for h in words], pa.binary()),
                 pa.array([k.tolist() if len(h) else None for k, h in zip(keys, words, strict=True)], pa.list_(pa.int64()))],
                ["doc_id", "content", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind(docs)}, content binary, bands array<long>")


def sketches(texts: DataFrame) -> DataFrame:
    """(content, sig, units) of (doc_id, text): the low 16 bits of each coordinate, and the units."""

    def run(batches):
        for _, texts in slices(batches, size=SLICE, rows=SLICE_ROWS):
            words = [h for h in hashed_texts(texts) if len(h)]
            own = [shingle_hashes(h, WORDS) for h in words]
            low = (signatures(own) & _U(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([content_of(h) for h in words], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([units_of(e).tobytes() for e in own], pa.binary())],
                ["content", "sig", "units"])

    return texts.select("doc_id", "text").mapInArrow(run, "content binary, sig binary, units binary")


def verified(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) that are similar enough."""

    def run(batches):
        for batch, left in slices(batches, "_ua", 1 << 22):
            both = zip(left, batch.column("_ub").to_pylist(), strict=True)
            keep = pa.array([jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least for x, y in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    left = sketch.select(F.col("rep").alias("a"), F.col("units").alias("_ua"))
    right = sketch.select(F.col("rep").alias("b"), F.col("units").alias("_ub"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_ua", "_ub").mapInArrow(run, "a long, b long")


def linked_in_blocks(members: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members (key, band, rep, comp) of one key and of different components.

    A bucket is dealt into blocks and every pair of blocks is a piece of work
    of bounded size.  A pair is looked at in the first band that it shares,
    and first on the signatures; what comes out joins components, so a piece
    returns fewer links than it has members.
    """
    least_same = least - DEVIATIONS * math.sqrt(least * (1 - least) / (BANDS * ROWS))
    counts = members.groupBy("key").agg(F.count("*").alias("n"))
    own = to_hot(members, counts, "key", F.col("rep")).withColumn("_k", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = own.withColumn("x", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int")).withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    own = own.select("key", "band", F.least("x", "_y").alias("p"), F.greatest("x", "_y").alias("q"), "x", "rep", "comp")
    # rows as they are once every block stands beside every other of its bucket
    total = counts.agg(F.sum(F.col("n").cast("double") * F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    groups = max(1, int(total // GROUP_ROWS))
    own = own.join(sketch, "rep").select(F.pmod(F.xxhash64("key", "p", "q"), F.lit(groups)).alias("g"), "key", "band", "p", "q", "x", "rep", "comp", "sig", "units")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("key", "band", "p", "q", "x", "rep", "comp")}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        units = [np.frombuffer(u, np.uint32) for u in table.column("units").to_pylist()]
        order = np.lexsort((col["rep"], col["q"], col["p"], col["key"]))
        new = np.flatnonzero(np.r_[True, np.any([np.diff(col[c][order]) != 0 for c in ("key", "p", "q")], axis=0)])
        out: list[tuple[int, int]] = []
        for at in np.split(order, new[1:]):
            p, q, band = col["p"][at[0]], col["q"][at[0]], col["band"][at[0]]
            root = {c: c for c in col["comp"][at].tolist()}

            def top(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            rows, cols = at[col["x"][at] == p], at[col["x"][at] == q]
            for n, i in enumerate(rows):
                js = cols[n + 1 :] if p == q else cols
                js = js[col["comp"][js] != col["comp"][i]]
                if not len(js):
                    continue
                same = sig[js] == sig[i]
                first = same.reshape(len(js), BANDS, ROWS).all(axis=2).argmax(axis=1)
                likely = np.flatnonzero((same.mean(axis=1) >= least_same) & (first == band))
                for j in js[likely].tolist():
                    a, b = top(int(col["comp"][i])), top(int(col["comp"][j]))
                    if a != b and jaccard(units[i], units[j]) >= least:
                        root[max(a, b)] = min(a, b)
                        out.append((int(col["rep"][i]), int(col["rep"][j])))
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return own.groupBy("g").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = LEAST, within: Workspace | None = None) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its group), kept (doc_id = class_id).

    Groups are the connected components of links between documents whose
    weighted Jaccard similarity over runs of five words is at least `least`;
    documents with equal words are one from the start.  A text of fewer words
    is one run; documents without words, null texts included, are groups of
    their own.  Repeated rows get the same class; different texts that share a
    doc_id are compared as such; rows without a doc_id have the class of their
    group, null if no one in it has an id (all such rows are kept).  An empty
    table gives no rows; columns other than doc_id and text are not read;
    doc_id may be of any type that has an order.
    """
    ws = Workspace(docs.sparkSession, "minhash", within)
    own = ws.put(profiles(docs), "profiles")
    reps = own.where("content is not null").groupBy("content").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    reps = ws.put(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    members = ws.put(reps.select("rep", F.posexplode("bands").alias("band", "key")), "members")
    shared = members.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_key"))
    members = ws.put(members.join(shared, F.col("key") == F.col("_key"), "left_semi").select("key", "band", "rep"), "shared")
    ws.drop("members")
    need = ws.put(members.select("rep").distinct().join(reps.select("rep", "content", "least_id"), "rep"), "need")
    # the texts are found by id, then by their own words; without an id all are looked at
    ids = need.where("least_id is not null").select(F.col("least_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    if not need.where("least_id is null").isEmpty():
        texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    sketch = sketches(texts).join(need.select(F.col("content").alias("_content"), "rep"), F.col("content") == F.col("_content")).select("rep", "sig", "units")
    sketch = ws.put(sketch.dropDuplicates(["rep"]), "sketches")
    links, comps = None, need.select(F.col("rep").alias("id"), F.col("rep").alias("comp"))
    for r in range(STAR_ROUNDS + 1):
        here = members.join(comps, F.col("rep") == F.col("id")).select("key", "band", "rep", "comp")
        apart = here.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("_c"), F.max("comp").alias("_d"), F.min(F.struct(F.xxhash64("rep", F.lit(r)).alias("h"), F.col("rep").alias("center"), F.col("comp").alias("other"))).alias("m")).where("_c < _d")
        apart = ws.put(apart, f"apart-{r}")
        if links is not None and apart.isEmpty():
            break
        here = to_hot(here, apart.select("key", "n", "m.center", "m.other"), "key", F.col("rep"))
        if r < STAR_ROUNDS:
            pairs = here.where("comp <> other").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"))
            found = verified(pairs.distinct(), sketch, least)
        else:  # all that share a key and are still apart
            found = linked_in_blocks(ws.put(here.select("key", "band", "rep", "comp"), "rest"), sketch, least)
        found = ws.put(found, f"links-{r}")
        links = found if links is None else links.union(found)
        ids = connected_components(ws, links, f"comps-{r}")
        comps = ws.put(need.select("rep").join(ids, F.col("rep") == F.col("id"), "left").select(F.col("rep").alias("id"), F.coalesce("comp", "rep").alias("comp")), f"comps-{r}-all")
    ws.drop("sketches", "shared", "rest", "need")
    grouped = reps.select("content", "rep", "least_id").join(comps, F.col("rep") == F.col("id"), "left").select("content", "least_id", F.coalesce("comp", "rep").alias("comp"))
    classes = grouped.groupBy("comp").agg(F.min("least_id").alias("_class"))
    classes = ws.put(grouped.join(classes, "comp").select(F.col("content").alias("_content"), "_class"), "classes")
    out = own.join(classes, F.col("content") == F.col("_content"), "left").select("doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("_class")).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))


def op2_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
