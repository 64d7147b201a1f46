"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every window of WINDOW bytes has an entropy.  How rare a window is, is how few
windows of the whole corpus have an entropy like its own; windows of hardly any
entropy don't count.  A window that is the rarest of its neighbours time and
again, as a frame of NEIGHBOURS windows slides over the text, is a feature.  A
text's different features go into Bloom filters one after another, a full one
being followed by the next.  Two fingerprints are alike as far as the bits that
they share exceed what chance would give.
"""

from __future__ import annotations

import binascii
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slotwise.llm.common import BASE, Workspace, free_name, mix, read, slices

WINDOW = 32
#: Windows in a frame, and frames of which a window must be the rarest.
NEIGHBOURS, OFTEN = 32, 8
BINS = 1000
#: Bins of too little entropy to tell texts apart.
WEAK = 200
FILTER_BITS, PLACES, FULL = 2048, 5, 160
#: Deviations over the bits that two filters share by chance from which they are alike.
DEVIATIONS = 3.0
#: Bytes of text that are looked at together.
STRETCH = 1 << 18
_AT = 21  # bits of a place within a stretch
_NONE = np.int32(2**31 - 1)
_U = np.uint64
#: c * log2(c) in units of 2**-16: sums of whole numbers don't depend on where a sum begins.
_WORTH = np.array([round(c * np.log2(c) * 65536) if c else 0 for c in range(WINDOW + 1)], np.int64)
_GAIN = np.diff(_WORTH).astype(np.int32)


def entropy_bins(raw: np.ndarray) -> np.ndarray:
    """For every window of the bytes, by its first byte, its entropy from 0 to BINS.

    A byte that enters a window changes the sum over the window's counts by what
    its own count gains, one that leaves by what it loses.  Both counts follow
    from how near the equal bytes before and after stand, which a stable sort
    by value shows.
    """
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    order = np.argsort(raw, kind="stable").astype(np.int32)
    key = raw[order].astype(np.int32) * np.int32(n + WINDOW) + order
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        near = (key[k:] - key[:-k]) < WINDOW
        if not near.any():
            break
        before[k:] += near
        after[:-k] += near
    change = np.empty(n, np.int32)
    change[order] = _GAIN[before]
    lost = np.empty(n, np.int32)
    lost[order] = _GAIN[after]
    change[WINDOW:] -= lost[:-WINDOW]
    sums = np.cumsum(change, dtype=np.int64)[WINDOW - 1 :]
    return ((_WORTH[-1] - sums) * BINS // _WORTH[-1]).astype(np.int32)


def whole_windows(ends: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n joined bytes lie within one text; ends: where the texts end."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(ends - WINDOW + 1, 0), 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[: max(0, n - WINDOW + 1)]) <= 0


def chosen(rank: np.ndarray) -> np.ndarray:
    """Places of the windows that are the rarest, the first of equals, of at least OFTEN frames; _NONE is no window's rank."""
    m = len(rank)
    key = np.full(m + 2 * (NEIGHBOURS - 1), _NONE, np.int32)
    key[NEIGHBOURS - 1 : NEIGHBOURS - 1 + m] = np.where(rank == _NONE, _NONE, (rank << _AT) | np.arange(m, dtype=np.int32))
    width = 1
    while width < NEIGHBOURS:
        more = min(width, NEIGHBOURS - width)
        key = np.minimum(key[:-more], key[more:])
        width += more
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    first, end = np.r_[0, edge], np.r_[edge, len(key)]
    best = key[first]
    return (best[(end - first >= OFTEN) & (best != _NONE)] & ((1 << _AT) - 1)).astype(np.int64)


def window_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(raw[at[:, None] + np.arange(WINDOW)]).view(np.uint64)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            out = mix(out * _U(BASE) + mix(words[:, k]))
    return out


def stretches(texts: list[bytes]):
    """(numbers of texts, bytes, ends of texts, first and last window that count) of about STRETCH bytes; long texts in parts that overlap."""
    at = 0
    while at < len(texts):
        t = texts[at]
        if len(t) > STRETCH:
            raw = np.frombuffer(t, np.uint8)
            for low in range(0, len(t) - WINDOW + 1, STRETCH):
                high = min(low + STRETCH, len(t) - WINDOW + 1)
                a, b = max(0, low - NEIGHBOURS + 1), min(len(t), high + NEIGHBOURS + WINDOW - 2)
                yield np.array([at]), raw[a:b], np.array([b - a]), low - a, high - a
            at += 1
            continue
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= STRETCH):
            held += len(texts[end])
            end += 1
        yield np.arange(at, end), np.frombuffer(b"".join(texts[at:end]), np.uint8), np.cumsum([len(t) for t in texts[at:end]]), 0, held
        at = end


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of the different features of all texts, in their order; a text without any is one itself."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for number, raw, ends, low, high in stretches(texts):
        bins = entropy_bins(raw)
        rank = np.where(whole_windows(ends, len(raw)) & (bins >= WEAK), ranks[bins], _NONE)
        at = chosen(rank)
        at = at[(at >= low) & (at < high)]
        owners.append(number[np.searchsorted(ends, at, "right")])
        hashes.append(window_hashes(raw, at))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    alone = np.setdiff1d(np.flatnonzero([len(t) > 0 for t in texts]), owner)
    owner = np.r_[owner, alone]
    h = np.r_[h, np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in alone.tolist()], np.uint64)]
    order = np.lexsort((np.arange(len(h)), h, owner))
    again = np.r_[False, (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1])] if len(h) else np.zeros(0, bool)
    keep = np.sort(order[~again])
    keep = keep[np.argsort(owner[keep], kind="stable")]
    return owner[keep], h[keep]


class Print:
    """A fingerprint: the number of its features, and its filters as rows of 64-bit words."""

    __slots__ = ("n", "filters")

    def __init__(self, n: int, filters: np.ndarray):
        self.n, self.filters = n, filters

    def __str__(self) -> str:
        return f"{self.n}:{binascii.b2a_base64(self.filters.tobytes(), newline=False).decode()}"

    @classmethod
    def read(cls, text: str) -> Print:
        n, _, rest = text.partition(":")
        return cls(int(n), np.frombuffer(binascii.a2b_base64(rest), np.uint64).reshape(-1, FILTER_BITS // 64))

    def like(self, other: Print) -> float:
        """From 0 to 1: how far the shared bits exceed chance, of the best filter of the other for each of the one's, by its features.

        The one is that of fewer features; of as many, each is the one in turn
        and the better counts.  Two without features are alike.
        """
        if not self.n or not other.n:
            return float(self.n == other.n)
        if self.n == other.n:
            return max(self._within(other), other._within(self))
        return self._within(other) if self.n < other.n else other._within(self)

    def _within(self, other: Print) -> float:
        m = float(FILTER_BITS)
        b = np.bitwise_count(other.filters).sum(axis=1, dtype=np.int64)
        total = 0.0
        for k, own in enumerate(self.filters):
            a = int(np.bitwise_count(own).sum())
            both = np.bitwise_count(own & other.filters).sum(axis=1, dtype=np.int64)
            chance = a * b / m
            least = chance + DEVIATIONS * np.sqrt(chance * (1 - a / m) * (1 - b / m))
            most = np.minimum(a, b)
            score = np.where(most > least, (both - least) / np.maximum(most - least, 1e-9), both == np.maximum(a, b))
            total += min(1.0, max(0.0, float(score.max()))) * min(FULL, self.n - k * FULL)
        return total / self.n


def prints(texts: list[str], ranks: np.ndarray) -> list[Print]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    owner, h = features(raw, ranks)
    n = np.bincount(owner, minlength=len(raw))
    chain = -(-n // FULL)
    base = np.cumsum(chain) - chain
    first = np.cumsum(n) - n
    filter_ = base[owner] + (np.arange(len(h)) - first[owner]) // FULL
    out, words = [], FILTER_BITS // 64
    bits = np.zeros((int(chain.sum()), FILTER_BITS), bool)
    for k in range(PLACES):
        bits[filter_, (h >> _U(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64).reshape(-1, words)
    for i in range(len(raw)):
        out.append(Print(int(n[i]), packed[base[i] : base[i] + chain[i]].copy()))
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the bins of entropy, 0 the rarest, by how many windows of all texts have them; sums of BINS + 1 numbers a task come together."""

    def run(batches):
        held = np.zeros(BINS + 1, np.int64)
        for _, texts in slices(batches, 0):
            for _, raw, ends, low, high in stretches([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
                bins = entropy_bins(raw)
                good = whole_windows(ends, len(raw))
                good[:low] = good[high:] = False
                held += np.bincount(bins[good], minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], ["bin", "n"])

    found = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    counts = np.zeros(BINS + 1, np.int64)
    for r in found:
        counts[r["bin"]] = r["n"]
    out = np.empty(BINS + 1, np.int32)
    out[np.argsort(counts, kind="stable")] = np.arange(BINS + 1, dtype=np.int32)
    return out


def fingerprinted(docs: DataFrame, ranks: np.ndarray | None = None, column: str = "fingerprint") -> DataFrame:
    """docs, row by row, with the fingerprint of each text in a new last column; one of the same ranks, the corpus' own if none are given.

    Null and empty texts have the fingerprint "0:"; a text shorter than a
    window, or without any window of enough entropy, is its one feature itself.
    Equal texts have equal fingerprints.  An empty table gives no rows.
    """
    ranks, name = rarity(docs) if ranks is None else ranks, free_name(docs, column)

    def run(batches):
        for b, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([str(p) for p in prints([t or "" for t in texts], ranks)], pa.string())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def likeness(a: str, b: str) -> float:
    return Print.read(a).like(Print.read(b))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many code points from the start of the following one, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(texts: list[str], own: list[Print], following: list[tuple[str, Print]], ranks: np.ndarray) -> list[pa.Array]:
    new = [edited(t, u) for t, (u, _) in zip(texts, following, strict=True)]
    other = prints(new, ranks)
    columns = (
        [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], [str(p) for p in own], [str(p) for p in other],
        [p.like(q) for p, q in zip(own, other, strict=True)], [p.like(q) for p, (_, q) in zip(own, following, strict=True)])
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def edits_compared(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how like its own the edited and the next document's are.

    The next document is that of the next doc_id, null ones first, after the
    last the first; rows of one doc_id stand in the order of their texts'
    hashes.  A table of one row follows itself.  Null texts count as empty;
    repeated rows are rows of their own; other columns are not read; an empty
    table gives no rows.

    Texts are dealt once, by ranges of doc_id, and each task goes through its
    range.  The last row of a range waits for the first of the next; those two
    rows a range meet afterwards.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "fingerprints")
    ranks = rarity(docs) if ranks is None else ranks
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "_tie", "_row"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ends = ["_part", "_first", "_text", "_print"]

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        names = [*RESULT, *ends]

        def end(doc_id, first, text, own):
            """A row that waits: _first says whether it is the first of its range, or else the last."""
            return pa.RecordBatch.from_arrays([doc_id, *(pa.nulls(1, k) for k in _KINDS), pa.array([part], pa.int32()), pa.array([first]), pa.array([text], pa.string()), pa.array([str(own)])], names)

        for b, texts in slices(batches, "text"):
            ids, texts = b.column("doc_id"), [t or "" for t in texts]
            own = prints(texts, ranks)
            if held is None:
                yield end(pa.nulls(1, ids.type), True, texts[0], own[0])
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, own = [held[1], *texts], [held[2], *own]
            held = ids.slice(len(ids) - 1), texts[-1], own[-1]
            if len(texts) > 1:
                out = _compared(texts[:-1], own[:-1], list(zip(texts[1:], own[1:], strict=True)), ranks)
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *out, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
        if held is not None:
            yield end(held[0], False, held[1], held[2])

    rows = ws.put(ranged.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_NAMES}, _part int, _first boolean, _text string, _print string"), "rows")
    # a row a range
    after = rows.where("_first").select("_part", F.coalesce(F.lead("_part").over(W.orderBy("_part")), F.min("_part").over(W.partitionBy())).alias("_next"))
    firsts = rows.where("_first").select(F.col("_part").alias("_next"), F.col("_text").alias("_next_text"), F.col("_print").alias("_next_print"))
    pairs = rows.where("not _first").select("doc_id", *ends).join(after, "_part").join(firsts, "_next").select("doc_id", "_text", "_print", "_next_text", "_next_print")

    def finish(batches):
        for b in batches:
            texts, own, more, others = (b.column(k).to_pylist() for k in range(1, 5))
            out = _compared(texts, [Print.read(p) for p in own], [(t, Print.read(p)) for t, p in zip(more, others, strict=True)], ranks)
            yield pa.RecordBatch.from_arrays([b.column(0), *out], RESULT)

    return rows.where("_part is null").select(*RESULT).unionByName(pairs.mapInArrow(finish, f"doc_id {kind}, {_NAMES}"))


def op11_document_fingerprints(spark, sf_dir):
    """Every document's fingerprint beside its edited text's and the next document's."""
    return edits_compared(read(spark, sf_dir, "documents"))
