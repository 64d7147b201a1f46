"""Merkle manifest of a table: a hash tree over its rows for each language, and one over the languages.

A partition of the ordered rows is a fragment of a forest: it holds the nodes
that it cannot resolve, keyed by tree, level and index.  Two fragments merge by
putting their nodes together; whenever all siblings of a run are there - how
many they are is known from the tree's size - they give way to their parent.
That is associative and commutative, and what stays of a fragment is a node or
two for each level.  Fragments are merged FAN at a time, round after round, up
to one; each round is a written table, so a lost executor costs a task of it.

On the way back each round's tables say which siblings each of their nodes met,
so that a row's proof is its way within its partition, followed by the ways of
unresolved nodes from round to round.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slotwise.llm.common import Workspace, read
from slotwise.operators.ordered import running

#: Rows that a partition of the tree holds, about: digests, no texts.
LEAVES = 1 << 16
#: Fragments that one task merges.
FAN = 64
#: The tree over the languages' trees.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7

Nodes = dict[tuple[int, int], dict[int, str]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(*values: Column) -> Column:
    """Hash of a row's values, each `-` if null, else its length in bytes, a colon and itself."""
    said = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def grown(nodes: Nodes, sizes: dict[int, int]) -> tuple[dict[tuple[int, int, int], str], Nodes]:
    """Merge what can be merged of a fragment.

    nodes: digests by (tree, level) and index; sizes: how many leaves each of
    the trees has.  Gives the step of each node that found its siblings - L or R
    and the sibling's digest, by the side where it stands, or - where it has none
    - and the nodes that found none.  A tree's root is a leaf of the tree TOP.
    """
    steps: dict[tuple[int, int, int], str] = {}
    known: Nodes = defaultdict(dict)
    for key, own in nodes.items():
        known[key] |= own
    left: Nodes = defaultdict(dict)
    for tree in sorted({t for t, _ in known} | {TOP}, key=lambda t: (t == TOP, t)):
        width, level = sizes[tree], 0
        while width > 1:
            own, above = known.pop((tree, level), {}), known[(tree, level + 1)]
            for i, d in own.items():
                if i == width - 1 and not i & 1:
                    steps[tree, level, i] = "-"
                    above[i >> 1] = digest(d)
                elif (i ^ 1) not in own:
                    left[tree, level][i] = d
                elif not i & 1:
                    steps[tree, level, i], steps[tree, level, i + 1] = "R" + own[i + 1], "L" + d
                    above[i >> 1] = digest(d, own[i + 1])
            width, level = -(-width // 2), level + 1
        if root := known.pop((tree, level), None):
            if tree == TOP:
                left[TOP, level] = root
            else:
                known[TOP, 0][tree] = root[0]
    return steps, {k: v for k, v in left.items() if v}


def merged(a: Nodes, b: Nodes, sizes: dict[int, int]) -> Nodes:
    """The monoid's operation; its neutral element is the empty fragment."""
    both: Nodes = defaultdict(dict)
    for part in (a, b):
        for key, own in part.items():
            both[key] |= own
    return grown(both, sizes)[1]


def way(steps: dict[tuple[int, int, int], str], sizes: dict[int, int], node: tuple[int, int, int]) -> tuple[list[str], tuple[int, int, int]]:
    """(steps from a node on, the node at which they end)."""
    out, (tree, level, i) = [], node
    while True:
        if (step := steps.get((tree, level, i))) is not None:
            out.append(step)
            level, i = level + 1, i >> 1
        elif tree != TOP and level >= (sizes[tree] - 1).bit_length():
            tree, level, i = TOP, 0, tree
        else:
            return out, (tree, level, i)


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for step in path:
        side, sibling = step[0], step[1:]
        leaf = digest(sibling, leaf) if side == "L" else digest(leaf, sibling)
    return leaf


_NODE = "part int, tree long, size long, level int, index long, digest string"


def _nodes(t: pa.Table, at: int | None, top: int) -> tuple[Nodes, dict[int, int], list[tuple[int, int, int]]]:
    """Nodes, sizes and their keys in order; at: the level of all rows, if they have no column for it."""
    tree, index, said = (t.column(c).to_pylist() for c in ("tree", "index", "digest"))
    level = t.column("level").to_pylist() if at is None else [at] * t.num_rows
    keys = list(zip(tree, level, index, strict=True))
    nodes: Nodes = defaultdict(dict)
    for (a, b, i), d in zip(keys, said, strict=True):
        nodes[a, b][i] = d
    return nodes, dict(zip(tree, t.column("size").to_pylist(), strict=True)) | {TOP: top}, keys


def _unresolved(part: int, left: Nodes, sizes: dict[int, int]) -> pa.Table:
    rows = [(part, t, sizes[t], n, i, d) for (t, n), own in left.items() for i, d in own.items()]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["part", "tree", "size", "level", "index", "digest"])


def tree_reduced(ws: Workspace, leaves: DataFrame, parts: int, top: int) -> tuple[list[DataFrame], str]:
    """(a table of unresolved nodes for each round, the root) of leaves (part, tree, size, index, digest)."""

    def first(t: pa.Table) -> pa.Table:
        nodes, sizes, _ = _nodes(t, 0, top)
        return _unresolved(t.column("part")[0].as_py(), grown(nodes, sizes)[1], sizes)

    def further(t: pa.Table) -> pa.Table:
        nodes, sizes, _ = _nodes(t, None, top)
        return _unresolved(t.column("part")[0].as_py() // FAN, grown(nodes, sizes)[1], sizes)

    rounds = [ws.put(leaves.groupBy("part").applyInArrow(first, _NODE), "round-0")]
    while parts > 1:
        parts = -(-parts // FAN)
        rounds.append(ws.put(rounds[-1].groupBy(F.expr(f"cast(part div {FAN} as int)")).applyInArrow(further, _NODE), f"round-{len(rounds)}"))
    return rounds, rounds[-1].first()["digest"]


def paths_down(ws: Workspace, rounds: list[DataFrame], top: int) -> DataFrame:
    """(part, tree, level, index, path) of the nodes that the partitions left unresolved: their steps up to the root."""
    own = rounds[-1].select("part", "tree", "level", "index", F.array().cast("array<string>").alias("path"))

    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(["part", "tree", "level", "index"]).append_column("path", pa.array([], pa.list_(pa.string())))
        nodes, sizes, keys = _nodes(t, None, top)
        steps, _ = grown(nodes, sizes)
        ups = dict(zip(zip(*(above.column(c).to_pylist() for c in ("tree", "level", "index")), strict=True), above.column("path").to_pylist(), strict=True))
        found = (way(steps, sizes, k) for k in keys)
        return t.select(["part", "tree", "level", "index"]).append_column("path", pa.array([path + ups[end] for path, end in found], pa.list_(pa.string())))

    for k in range(len(rounds) - 2, -1, -1):
        below = rounds[k].groupBy(F.expr(f"cast(part div {FAN} as int)").alias("_g")).cogroup(own.groupBy(F.col("part").alias("_g")))
        own = ws.put(below.applyInArrow(run, "part int, tree long, level int, index long, path array<string>"), f"paths-{k}")
    return own


@dataclass(frozen=True)
class Manifest:
    """rows: the leaves given, with subroot and path; trees: (lang, tree, size) of each tree; root: null for an empty table."""

    rows: DataFrame
    trees: DataFrame
    root: str | None


def manifest(leaves: DataFrame, ws: Workspace) -> Manifest:
    """The tree over leaves (lang, doc_id, leaf, ...), and for each row its subroot and path.

    A path's steps go from the leaf to the root: L or R, the side where the
    sibling stands, and its digest, or - for a node without one.  Rows stand in
    order of lang (null first, then by bytes), doc_id (null first) and leaf; equal
    rows are leaves of their own.  An empty table gives no rows, no trees and no
    root.  Further columns are kept; none may be called part, tree, size, index,
    level, digest, path, subroot, or begin with an underscore.
    """
    spark = leaves.sparkSession
    given = ws.put(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    langs = ws.put(given.groupBy("lang").agg(F.count("*").alias("size")), "langs")
    ranked = running(langs, ["lang"], None, "tree", keep=lambda df: ws.put(df, "ranges"))
    trees = ws.put(ranked.select(F.col("lang").alias("_lang"), "tree", "size"), "trees")
    rows, top = trees.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return Manifest(given.drop("_row").withColumn("subroot", F.lit(None).cast("string")).withColumn("path", F.array().cast("array<string>")), trees.withColumnRenamed("_lang", "lang"), None)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAVES))
    order = ["doc_id", "leaf", "_row"]
    placed = ws.put(given.repartitionByRange(parts, "lang", *order).withColumn("part", F.spark_partition_id()), "placed")
    # the languages' trees are numbered in the order in which the ranges stand, so parts hold neighbours
    before = placed.groupBy("part", "lang").agg(F.count("*").alias("_n"))
    before = before.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).select(F.col("part").alias("_part"), F.col("lang").alias("_of"), "_base", "tree", "size")
    w = W.partitionBy("part", "lang").orderBy(*order)
    at = placed.withColumn("_k", F.row_number().over(w) - 1).join(before, (F.col("part") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_of")))
    at = ws.put(at.withColumn("index", F.col("_base") + F.col("_k")).drop("_part", "_of", "_base", "_k", "_row"), "at")
    ws.drop("leaves", "placed")
    forest = at.select("part", "tree", "size", "index", F.col("leaf").alias("digest"))
    rounds, root = tree_reduced(ws, forest, parts, top)
    up = paths_down(ws, rounds, top)
    kept = [f for f in at.schema.fields if f.name not in ("part", "tree", "size", "index")]

    names = [f.name for f in kept]

    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        nodes, sizes, keys = _nodes(t.append_column("digest", t.column("leaf")), 0, top)
        steps, _ = grown(nodes, sizes)
        ups = dict(zip(zip(*(above.column(c).to_pylist() for c in ("tree", "level", "index")), strict=True), above.column("path").to_pylist(), strict=True))
        subroots: dict[int, str] = {}
        paths, own = [], []
        for key in keys:
            path, end = way(steps, sizes, key)
            path += ups[end]
            tree = key[0]
            if tree not in subroots:
                subroots[tree] = folded(nodes[tree, 0][key[2]], path[: (sizes[tree] - 1).bit_length()])
            paths.append(path)
            own.append(subroots[tree])
        return t.select(names).append_column("subroot", pa.array(own, pa.string())).append_column("path", pa.array(paths, pa.list_(pa.string())))

    schema = T.StructType([*kept, T.StructField("subroot", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))])
    out = at.groupBy("part").cogroup(up.groupBy("part")).applyInArrow(run, schema)
    return Manifest(out, trees.withColumnRenamed("_lang", "lang"), root)


def refolded(rows: DataFrame, leaf: str, root: str | None, name: str = "folded_root") -> DataFrame:
    """A manifest's rows with the root that the given column's leaf and the row's own siblings give, the digest of these siblings, and whether the root is right."""
    new = [("proof_sha256", pa.string()), (name, pa.string()), ("verified", pa.bool_())]

    def run(batches):
        for b in batches:
            paths = b.column("path").to_pylist()
            roots = [folded(d, p) for d, p in zip(b.column(leaf).to_pylist(), paths, strict=True)]
            proofs = [digest(*(s[1:] for s in p)) for p in paths]
            out = (proofs, roots, [r == root for r in roots])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, (_, k) in zip(out, new, strict=True))], [*b.schema.names, *(n for n, _ in new)])

    more = [T.StructField(n, T.BooleanType() if k == pa.bool_() else T.StringType()) for n, k in new]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def row_leaves(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, lang, leaf, ...) of documents, their texts read where they lie."""
    return docs.select("doc_id", "lang", row_digest(*(F.col(c) for c in COLUMNS)).alias("leaf"), *more)


def write_manifest(docs: DataFrame, path: str) -> str | None:
    """Write rows (doc_id, lang, leaf, subroot, path), trees (lang, subroot, size) and the root under a path; gives the root.

    Null values are hashed as such, null and repeated ids are rows like others,
    other columns are not read; an empty table has tables without rows and no root.
    """
    ws = Workspace(docs.sparkSession, "manifest")
    found = manifest(row_leaves(docs), ws)
    found.rows.write.parquet(f"{path}/rows")
    rows = docs.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy("lang").agg(F.min("subroot").alias("subroot"), F.count("*").alias("size")).write.parquet(f"{path}/trees")
    docs.sparkSession.createDataFrame([(found.root,)], "root string").write.parquet(f"{path}/root")
    ws.close()
    return found.root


def op13_merkle_manifest(spark, sf_dir):
    """Every document's leaf, trees and proof, and what tampering with some rows does to the root that they fold to."""
    docs = read(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    more = F.when(hit, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    other = row_digest(*(more if c == "n_chars" else F.col(c) for c in COLUMNS)).alias("shown")
    found = manifest(row_leaves(docs, other), Workspace(spark, "merkle"))
    out = refolded(found.rows, "shown", found.root).withColumn("root", F.lit(found.root))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
