"""Line dedup by a deletion-neighbourhood join, one word of edit distance.

A line is its sequence of words.  Its neighbourhood is what deleting one word
leaves.  Two lines that leave the same at the same place differ in one word; a
line that equals what another leaves differs from it by one deleted word.  Both
are equal keys, hashed, and each key's earliest line is all that is needed of
it, so a key shared by many lines is aggregated and never gathered.  The link to
the earliest line is then verified on the words.

An edit changes only one half of a line.  Lines of which neither half occurs in
another line of fitting length have no neighbour, and their neighbourhoods are
not made; that loses nothing and leaves few lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import BASE, Workspace, _powers, free_name, hashed_words, mix, read, signed, slices, to_hot

#: Shorter lines are compared for equality only: one word of them is too much.
LEAST_WORDS = 5
CHUNK = 1_000_000
#: Repeats of a line within a chunk from which its rows are dealt over SALTS tasks.
OFTEN, SALTS = 8, 16
#: Rows of a batch of neighbourhoods, about.
BATCH = 65_536
_U = np.uint64


class Lines:
    """The words of many lines, with hashes of any run of a line's words in constant time."""

    def __init__(self, lines: list[str]):
        self.h, bounds = hashed_words(lines)
        self.start, self.end = bounds[:-1], bounds[1:]
        self.n = self.end - self.start
        up, self.down = _powers(len(self.h) + 2)
        with np.errstate(over="ignore"):
            self.sums = np.r_[_U(0), np.cumsum(self.h * up[: len(self.h)], dtype=np.uint64)]

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words from a to b, exclusive; the same wherever the run stands."""
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a]

    def second(self) -> np.ndarray:
        """Another hash of each whole line."""
        with np.errstate(over="ignore"):
            sums = np.r_[_U(0), np.cumsum(mix(self.h) * _powers(len(self.h) + 2)[0][: len(self.h)], dtype=np.uint64)]
            return mix((sums[self.end] - sums[self.start]) * self.down[self.start])

    def halves(self) -> list[np.ndarray]:
        """Keys of the halves, as a line of its length and as one with a word deleted."""
        out = []
        for m in (self.n, self.n + 1):
            head, tail = m // 2, np.minimum(m - m // 2, self.n)
            for tag, key in ((1, self.run(self.start, self.start + head)), (2, self.run(self.end - tail, self.end))):
                with np.errstate(over="ignore"):
                    out.append(mix(mix(key) + m.astype(np.uint64) * _U(BASE) + _U(tag)))
        return out

    def left_by_deletion(self, i: int) -> np.ndarray:
        """Hashes of line i without each of its words in turn."""
        at = np.arange(self.start[i], self.end[i])
        first = np.full(len(at), self.start[i])
        with np.errstate(over="ignore"):
            head = self.run(first, at)
            # what stands behind moves one place to the front
            rest = (self.sums[self.end[i]] - self.sums[at + 1]) * self.down[self.start[i] + 1]
            return mix(head + rest)

    def whole(self) -> np.ndarray:
        return mix(self.run(self.start, self.end))


def chunks(texts: list[str | None]):
    """(first, end, lines, owner of each line, its number) for about CHUNK characters at a time."""
    at = 0
    while at < len(texts):
        end, held, lines, owner, number = at, 0, [], [], []
        while end < len(texts) and (end == at or held + len(texts[end] or "") <= CHUNK):
            own = (texts[end] or "").split("\n")
            held += len(texts[end] or "")
            lines += own
            owner += [end] * len(own)
            number += range(len(own))
            end += 1
        yield at, end, lines, np.array(owner), np.array(number, np.int32)
        at = end


def line_table(docs: DataFrame, row: Column) -> DataFrame:
    """(doc_id, tie, row, line, n, h1, h2, salt, keys) of every line that has words; a row with line -1 and n lines for each document.

    row: a number of the document of its own.  tie: a hash of its text, so that
    rows of one doc_id have an order of their own.  salt: 0, or one of 1..SALTS
    where the line is frequent in its chunk.
    """

    def run(batches):
        kind = pa.list_(pa.int64(), 4)
        for b, texts in slices(batches, 1, 1 << 22):
            for at, end, lines, owner, number in chunks(texts):
                ids, tie, all_rows = (b.column(k)[at:end] for k in (0, 2, 3))
                x = Lines(lines)
                own = np.flatnonzero(x.n > 0)
                whole = x.whole()
                _, back, times = np.unique(whole[own], return_inverse=True, return_counts=True)
                mine = pa.array(owner[own] - at)
                rows = all_rows.to_numpy()[owner[own] - at]
                salt = np.where(times[back] >= OFTEN, 1 + (mix(rows.astype(np.uint64)) % _U(SALTS)).astype(np.int32), 0).astype(np.int32)
                keys = np.stack([k[own] for k in x.halves()], axis=1)
                near = x.n[own] >= LEAST_WORDS
                flat = pa.array(signed(keys.ravel()), mask=np.repeat(~near, 4))
                counts = np.bincount(owner - at, minlength=end - at)
                names = ["doc_id", "tie", "row", "line", "n", "h1", "h2", "salt", "keys"]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(mine), tie.take(mine), pa.array(rows), pa.array(number[own]), pa.array(x.n[own].astype(np.int32)),
                     pa.array(signed(whole[own])), pa.array(signed(x.second()[own])), pa.array(salt), pa.FixedSizeListArray.from_arrays(flat, type=kind).cast(pa.list_(pa.int64()))], names)
                m = end - at
                yield pa.RecordBatch.from_arrays(
                    [ids, tie, all_rows, pa.array(np.full(m, -1, np.int32)), pa.array(counts.astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.list_(pa.int64()))], names)

    return docs.select("doc_id", "text", tie_of().alias("tie"), row.alias("row")).mapInArrow(run, "doc_id long, tie long, row long, line int, n int, h1 long, h2 long, salt int, keys array<long>")


def tie_of() -> Column:
    return F.xxhash64("text")


def neighbourhoods(wanted: DataFrame) -> DataFrame:
    """(h1, h2, first, left, place, words) of (text, lines(line, h1, h2, first)): what deletions leave, and at place -1 the line itself."""

    def run(batches):
        names = ["h1", "h2", "first", "left", "place", "words"]
        held: list[tuple] = []
        n = 0

        def batch(kind):
            h1, h2, first, left, words = zip(*held, strict=True)
            sizes = np.array([len(x) for x in left])
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            place[ends - 1] = -1
            said = np.full(int(ends[-1]), None, object)
            said[ends - 1] = words
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(h1, sizes)), pa.array(np.repeat(h2, sizes)), pa.array(first, kind).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                 pa.array(np.concatenate(left)), pa.array(place.astype(np.int32)), pa.array(said, pa.binary())], names)

        kind = None
        for b, texts in slices(batches, 0):
            wants = b.column(1).to_pylist()
            kind = b.schema.field(1).type.value_type.field("first").type
            for t, want in zip(texts, wants, strict=True):
                own = (t or "").split("\n")
                want = [w for w in want if w["line"] < len(own)]
                x = Lines([own[w["line"]] for w in want])
                whole, second = signed(x.whole()), signed(x.second())
                for i, w in enumerate(want):
                    if whole[i] != w["h1"] or second[i] != w["h2"]:
                        continue  # another text of the same id and hash
                    left = signed(np.r_[x.left_by_deletion(i), x.whole()[i]])
                    held.append((w["h1"], w["h2"], w["first"], left, signed(x.h[x.start[i] : x.end[i]]).tobytes()))
                    n += len(left)
                if n >= BATCH:
                    yield batch(kind)
                    held, n = [], 0
        if held:
            yield batch(kind)

    kind = wanted.schema["lines"].dataType.elementType["first"].dataType.simpleString()
    return wanted.select("text", "lines").mapInArrow(run, f"h1 long, h2 long, first {kind}, left long, place int, words binary")


def one_word_apart(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one word is replaced, inserted or deleted between two sequences."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    m = len(a)
    same = a == b[:m]
    head = m if same.all() else int(same.argmin())
    return bool((a[head + (len(a) == len(b)) :] == b[head + 1 :]).all()) if head < len(b) else True


def near_lines(docs: DataFrame, distinct: DataFrame, ws: Workspace) -> DataFrame:
    """(h1, h2, near): of the lines with an earlier one within the bound, the first place of the earliest."""
    keys = distinct.where(f"n >= {LEAST_WORDS}").select("h1", "h2", "first", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_key"))
    some = keys.join(shared, F.col("key") == F.col("_key"), "left_semi").select("h1", "h2", "first").distinct()
    some = some.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.tie").alias("_tie")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h1", "h2", "first")).alias("lines"))
    # a text and its id tell which lines are looked for in it, so documents without an id have each their own
    wanted = docs.select("doc_id", "text", tie_of().alias("tie")).join(some, (F.col("tie") == F.col("_tie")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "lines")
    left = ws.put(neighbourhoods(wanted), "left")
    at_place = left.groupBy("left", "place").agg(F.min("first").alias("m"), F.count("*").alias("c"))
    by = at_place.groupBy("left").agg(F.sum("c").alias("_c"), F.min(F.when(F.col("place") >= 0, F.col("m"))).alias("_cut"), F.min(F.when(F.col("place") < 0, F.col("m"))).alias("_whole")).where("_c > 1")
    same = at_place.where("place >= 0 and c > 1").select("left", "place", F.col("m").alias("_same"))
    own = left.select("h1", "h2", "first", "left", "place")
    met = own.join(by, "left").join(same, ["left", "place"], "left")
    best = F.when(F.col("place") < 0, F.col("_cut")).otherwise(F.least("_whole", "_same"))
    found = met.select("h1", "h2", "first", best.alias("near")).where("near < first").groupBy("h1", "h2", "first").agg(F.min("near").alias("near"))
    words = left.where("place < 0").select(F.col("first").alias("_first"), "words").dropDuplicates(["_first"])
    # many lines may be near one
    earliest = found.groupBy("near").agg(F.count("*").alias("n")).join(words.select(F.col("_first").alias("near"), F.col("words").alias("_b")), "near")
    both = found.join(words, F.col("first") == F.col("_first")).withColumnRenamed("words", "_a").drop("_first")
    both = to_hot(both, earliest, "near", F.col("h1")).select("h1", "h2", "near", "_a", "_b")

    def run(batches):
        for b, left in slices(batches, 3):
            pairs = zip(left, b.column(4).to_pylist(), strict=True)
            keep = [one_word_apart(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in pairs]
            yield b.select(["h1", "h2", "near"]).filter(pa.array(keep, pa.bool_()))

    kind = both.schema["near"].dataType.simpleString()
    return both.mapInArrow(run, f"h1 long, h2 long, near {kind}")


def line_decisions(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per document: doc_id, row, n_lines, n_kept, dropped (numbers of its dropped lines, from 0, ascending).

    row is the column `key`, a number of the row that stays the same whenever
    docs is read; without it, numbers of no further meaning.

    A line goes if an earlier line, by doc_id and line number, is equal in
    words or, among lines of at least five words, one word apart.  Case,
    spacing and punctuation don't count.  Lines without words stay.  A null
    text is one empty line; repeated rows are documents of their own, so that
    the lines of the second go; rows of one doc_id stand in the order of a hash
    of their texts, whatever the partitions; a null doc_id comes first; an
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    ws = Workspace(docs.sparkSession, "lines")
    rows = ws.put(line_table(docs, F.monotonically_increasing_id() if key is None else F.col(key)), "rows")
    lines = rows.where("line >= 0")
    place = F.struct("doc_id", "tie", "row", "line")
    distinct = lines.groupBy("h1", "h2", "n").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys"))
    distinct = ws.put(distinct, "distinct")
    near = ws.put(near_lines(docs, distinct, ws), "near")
    ws.drop("left")
    marked = distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").where("times > 1 or near is not null").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "times", "first", "near")
    # a frequent line's rows carry salts
    marked = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("times") >= OFTEN, SALTS).otherwise(0)))).drop("times")
    gone = lines.join(marked, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("salt") == F.col("_salt"))).where(F.col("near").isNotNull() | (place != F.col("first"))).select("doc_id", "row", "line")
    all_rows = rows.where("line < 0").select("doc_id", "row", F.col("n").alias("n_lines"), F.lit(None).cast("int").alias("line")).unionByName(gone.withColumn("n_lines", F.lit(None).cast("int")))
    out = all_rows.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_list("line")).alias("dropped"))
    return out.select("doc_id", "row", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of their texts, each row's own; the first of equal rows keeps its lines."""
    ws = Workspace(docs.sparkSession, "deduped")
    key, mine, gone = (free_name(docs, c) for c in ("_key", "_row", "_gone"))
    keyed = ws.put(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    own = line_decisions(keyed, key).where(F.size("dropped") > 0).select(F.col("row").alias(mine), F.col("dropped").alias(gone))
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.get(F.transform(F.array(lines), lambda ls: F.transform(left, lambda i: F.get(ls, i))), F.lit(0)), "\n")
    out = keyed.join(own, F.col(key) == F.col(mine), "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_line_dedup(spark, sf_dir):
    """The decisions on every document; the dropped lines' numbers as text, separated by commas."""
    found = line_decisions(read(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",")).drop("row")
