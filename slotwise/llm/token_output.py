"""Token ids in a compressed binary format: static-range rANS, interleaved.

One frequency table, counted over all documents, serves every block.  A block
holds whole documents and is decoded by itself:

    magic "SWR1" | version u8 | id width u8 | lanes u16 | documents u32 |
    ids u64 | first id's place in its part u64 | words u32 | checkpoints u32 |
    table checksum u32 | payload checksum u32, then the payload:
    doc ids i64[], documents without an id as bits u8[], lengths u32[],
    final states u64[lanes], checkpoints (word place u32, states u64[lanes])[],
    words u32[]

All numbers are little-endian.  Ids lie in rows of `lanes` symbols; a lane has
its own 64-bit state, and all lanes share one word stream.  A checkpoint has
every lane's state before a row, so that a reader may start in the middle of a
block, or several may share one.  The rows of the table `blocks` are such
blocks; Spark commits their files as a whole, so a lost task leaves nothing.
"""

from __future__ import annotations

import struct
import threading
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotwise.llm.common import Workspace, read, slices

MAGIC = b"SWR1"
HEAD = struct.Struct("<4sBBHIQQIIII")
SCALE = 20  # table slots: 2**SCALE
LOW = 1 << 31
LANES = 4096
ROWS_BETWEEN = 64
BLOCK_IDS = 1 << 20
_U = np.uint64


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each id that occurs."""
    total, slots = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (slots / total))), 0).astype(np.int64)
    rest = slots - int(freq.sum())
    order = np.lexsort((np.arange(len(freq)), -freq))
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:  # take from the most frequent ids; they can spare it
        for i in order:
            if rest == 0 or freq[i] <= 1:
                break
            cut = min(-rest, max(1, int(freq[i]) // 64))
            freq[i] -= cut
            rest += cut
    return freq.astype(np.uint32)


class Table:
    """Frequencies with the lookups that coding needs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode_block(table: Table, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, place: int, lanes: int = LANES) -> bytes:
    """One block from the ids of whole documents; place: ids before it in its part."""
    n = len(ids)
    rows = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    f_all, s_all = table.freq[ids], table.start[ids]
    for r in range(rows - 1, -1, -1):
        lo, hi = r * lanes, min(n, (r + 1) * lanes)
        f, s, x = f_all[lo:hi], s_all[lo:hi], state[: hi - lo]
        full = x >= (f << _U(31 - SCALE + 32))
        if full.any():
            words.append((x[full] & _U(0xFFFFFFFF)).astype(np.uint32)[::-1])
            written += len(words[-1])
            x = np.where(full, x >> _U(32), x)
        q = x // f
        state[: hi - lo] = (q << _U(SCALE)) + (x - q * f) + s
        if r and r % ROWS_BETWEEN == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    missing = np.array([d is None for d in doc_ids], bool)
    body = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(missing).tobytes(), np.asarray(lengths, "<u4").tobytes(), state.astype("<u8").tobytes()]
    for at, x in reversed(marks):
        body += [struct.pack("<I", written - at), x.astype("<u8").tobytes()]
    payload = b"".join([*body, stream.astype("<u4").tobytes()])
    return HEAD.pack(MAGIC, 2, 4, lanes, len(doc_ids), n, place, written, len(marks), table.crc, zlib.crc32(payload)) + payload


def decode_block(table: Table, block: bytes, from_mark: int = 0, until_mark: int | None = None) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray, int]:
    """(doc ids, masked where there are none, lengths, ids, place); the ids only from one checkpoint to another, if given.

    Checkpoint 0 is the beginning, so readers that share a block take ranges of
    checkpoints.  Raises ValueError where the block or the table is not what
    was written.
    """
    magic, version, _, lanes, docs, n, place, n_words, n_marks, table_crc, crc = HEAD.unpack_from(block)
    payload = memoryview(block)[HEAD.size :]
    if magic != MAGIC or version != 2:
        raise ValueError("not a block of this format")
    if zlib.crc32(payload) != crc or table_crc != table.crc:
        raise ValueError("checksum differs")
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, missing = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)
    lengths, state = take("<u4", docs), take("<u8", lanes).copy()
    pos, first, last = 0, 0, -(-n // lanes)
    if until_mark is not None and until_mark <= n_marks:
        last = until_mark * ROWS_BETWEEN
    for k in range(1, n_marks + 1):
        where, x = int(take("<u4", 1)[0]), take("<u8", lanes)
        if k == from_mark:
            pos, first, state = where, k * ROWS_BETWEEN, x.copy()
    stream = take("<u4", n_words).astype(np.uint64)
    ids = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    mask = _U((1 << SCALE) - 1)
    for r in range(first, last):
        lo, hi = r * lanes, min(n, (r + 1) * lanes)
        x = state[: hi - lo]
        slot = x & mask
        sym = table.symbol[slot.astype(np.int64)]
        ids[lo - first * lanes : hi - first * lanes] = sym
        x = table.freq[sym] * (x >> _U(SCALE)) + slot - table.start[sym]
        low = np.flatnonzero(x < _U(LOW))
        if len(low):
            x[low] = (x[low] << _U(32)) | stream[pos : pos + len(low)]
            pos += len(low)
        state[: hi - lo] = x
    return np.ma.MaskedArray(doc_ids, missing), lengths, ids, place


def is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1, where lower case is the same everywhere and nothing combines."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """The tokenizers library with a bounded cache of white-space separated pieces.

    Valid for a tokenizer whose pieces never span white space, which the
    constructor checks on samples, and each call on one of its texts; other
    tokenizers, and calls whose text comes out otherwise, encode whole texts.  Texts
    of Latin-1 characters are lower-cased first, and sentence marks after an
    ASCII letter set apart, where the tokenizer does the same, so that the cache
    holds fewer forms.  When the cache is full it starts anew with the forms of the texts at hand.
    """

    CACHE = 700_000
    #: Texts are worked on in groups of about so many characters.
    GROUP = 6_000_000
    #: Longest text that a call is checked on.
    SAMPLE = 4_000

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end, self.calls = end_id, 0
        self.lowers = self.ids("AbÄÖÉ çÑ") == self.ids("abäöé çñ") and self.ids("ab, x1. é,") == self.ids("ab , x1 . é ,")
        bar = self.ids("|")
        self.bar = bar[0] if len(bar) == 1 and self.ids("a | b |") == [*self.ids("a"), *bar, *self.ids("b"), *bar] else None
        probe = ["a b", "It's 12\n\tx-y  z, ä", "the  the", " lead trail "]
        # ids that end a word, if the model marks them, tell words of letters apart without bars
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        words = ["the", "ab", "zxqvä", "ñandú"]
        self.ends = all(np.flatnonzero(self.last[self.ids(w)]).tolist() == [len(self.ids(w)) - 1] for w in words)
        self.by_piece = all(self.ids(t) == [i for w in self.plain(t).split(" ") for i in self.ids(w)] for t in probe)
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.filled = np.zeros(1 << 18, np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32), 0

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> str:
        """The text with spaces as the only white space of its own kind, and fewer forms of words."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        # the special tokens' own case counts
        return text.lower() if self.lowers and "<|" not in text and is_latin(text) else text

    def keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Put words into the cache, whose ids stand one after another."""
        n, m = len(self.cache), len(words)
        while n + m > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[n : n + m] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[n : n + m] = sizes
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.cache.update(zip(words, range(n, n + m), strict=True))

    def renew(self, forms: list[str]) -> None:
        """Begin a new cache with those of the forms that the old one has."""
        kept = [w for w in forms if w in self.cache]
        at = np.fromiter(map(self.cache.__getitem__, kept), np.int64, len(kept))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.clear()
        self.keep(kept, sizes, ids)

    def learn(self, fresh: list[str]) -> None:
        """Encode new pieces, many as one text.

        Words of letters stand between spaces, where ids that end a word tell
        them apart if there are as many as words.  Other pieces have a bar
        between them that is then found in the ids; those that hold one go alone.
        """
        if self.ends:
            words = [w for w in fresh if w.isalpha()]
            found = self.tok.encode_batch_fast([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found]) if words else np.zeros(0, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(words) and (not words or ends[-1] == len(ids) - 1):
                self.keep(words, np.diff(ends, prepend=-1), ids)
                fresh = [w for w in fresh if not w.isalpha()]
        known = len(self.cache)
        safe = [w for w in fresh if "|" not in w] if self.bar is not None else []
        if safe:
            found = self.tok.encode_batch_fast([" | ".join([*safe[i : i + 64], ""]) for i in range(0, len(safe), 64)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            bars = ids == self.bar
            ends = np.flatnonzero(bars)
            self.keep(safe, np.diff(ends, prepend=-1) - 1, ids[~bars])
        if len(self.cache) - known < len(fresh):
            alone = [w for w in fresh if w not in self.cache]
            found = [e.ids for e in self.tok.encode_batch_fast(alone, add_special_tokens=False)]
            self.keep(alone, np.array([len(i) for i in found]), np.array([x for i in found for x in i], np.uint32))

    def group(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.large_string())
        if self.lowers:
            latin = pa.array(["<|" not in t and is_latin(t) for t in texts])
            column = pc.if_else(latin, pc.replace_substring_regex(column, "([a-z])([.,]) ", r"\1 \2 "), column)
        words = pc.split_pattern(column, " ")
        flat = pc.dictionary_encode(words.flatten())
        forms = flat.dictionary.to_pylist()
        if len(self.cache) > self.CACHE:
            self.renew(forms)
        at = list(map(self.cache.get, forms))
        if None in at:
            fresh = [w for w, i in zip(forms, at, strict=True) if i is None]
            self.learn(fresh)
            learned = map(self.cache.__getitem__, fresh)
            at = [next(learned) if i is None else i for i in at]
        at = np.array(at, np.int64)[flat.indices.to_numpy()]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        if not self.by_piece:
            return [np.array([*self.ids(t or ""), self.end], np.uint32) for t in texts]
        out: list[np.ndarray] = []
        own, held = [], 0
        for k, t in enumerate(texts):
            own.append(self.plain(t or ""))
            held += len(own[-1])
            if held > self.GROUP or k == len(texts) - 1:
                out += self.group(own)
                own, held = [], 0
        # another text in each call
        some = next((k for k in range(self.calls % max(1, len(texts)), len(texts)) if len(texts[k] or "") <= self.SAMPLE), None)
        self.calls += 1
        if some is not None and self.ids(texts[some] or "") != out[some].tolist():
            self.by_piece = False
            return self(texts)
        return [np.append(x, x.dtype.type(self.end)) for x in out]


_ENCODERS: dict[tuple[str, int], Encoder] = {}
_DROP: list[threading.Timer] = []
#: Seconds without a task after which a process gives its encoder's memory back.
IDLE_S = 2.0


def encoder(path: str, end_id: int) -> Encoder:
    """The process's own encoder, whose cache a task that follows soon finds warm."""
    while _DROP:
        _DROP.pop().cancel()
    # a timer that is already running may take it from the table, but not from here
    own = _ENCODERS.get((path, end_id))
    if own is None:
        _ENCODERS.clear()
        own = _ENCODERS[path, end_id] = Encoder(path, end_id)
    return own


def idle() -> None:
    """A task is over: drop the encoder unless another begins soon."""
    timer = threading.Timer(IDLE_S, _ENCODERS.clear)
    timer.daemon = True
    timer.start()
    _DROP.append(timer)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): ids as zstd-compressed u16, or u32 where they need it; null texts count as empty."""

    def run(batches):
        import os

        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, pack = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=1)
        # its arrays are used again and again: blocks up to 32 MB stay with the process
        for b, texts in slices(batches, 1, 6 << 20, 4096, 32 << 20):
            runs = enc(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in runs], pa.int64()),
                 pa.array([pack.compress(x.astype("<u2" if x.max() < 65536 else "<u4").tobytes()) for x in runs], pa.binary())],
                ["doc_id", "n", "ids"])
        del enc
        idle()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary")


def unpacked(n: int, packed: bytes, unpack) -> np.ndarray:
    raw = unpack.decompress(packed)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def frequencies(ids: DataFrame, vocab: int) -> np.ndarray:
    """Counts of all ids over all documents; what comes to the driver is bounded by the vocabulary."""

    def run(batches):
        import zstandard

        unpack, counts = zstandard.ZstdDecompressor(), np.zeros(vocab, np.int64)
        for b, packs in slices(batches, 1, 1 << 22):
            own = zip(b.column(0).to_pylist(), packs, strict=True)
            while held := [unpacked(n, raw, unpack) for n, raw in islice(own, 2048)]:
                counts += np.bincount(np.concatenate(held), minlength=vocab)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    got = ids.select("n", "ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocab, np.int64)
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    return counts


def write_blocks(ids: DataFrame, freq: np.ndarray, path: str, parts: int) -> None:
    """Blocks of whole documents in ascending doc_id order, part after part."""

    def run(batches):
        import zstandard

        table, unpack = Table(freq), zstandard.ZstdDecompressor()
        part, number, place = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        runs: list[np.ndarray] = []
        held = 0

        def block():
            nonlocal number, place, docs, runs, held
            data = encode_block(table, docs, np.array([len(r) for r in runs]), np.concatenate(runs), place)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "number", "n", "block"])
            number, place, docs, runs, held = number + 1, place + held, [], [], 0
            return out

        for b, packs in slices(batches, 2, 1 << 22):
            for d, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), packs, strict=True):
                docs.append(d)
                runs.append(unpacked(n, raw, unpack))
                held += n
                if held >= BLOCK_IDS:
                    yield block()
        if docs:
            yield block()

    (
        ids.repartitionByRange(parts, "doc_id", "n").sortWithinPartitions("doc_id", "n", "ids")
        .mapInArrow(run, "part int, number int, n long, block binary")
        .write.option("compression", "none").parquet(path)
    )


def read_blocks(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the blocks."""

    def run(batches):
        table = Table(freq)
        for b, held in slices(batches, 1, 1 << 22):
            for part, block in zip(b.column(0).to_pylist(), held, strict=True):
                docs, lengths, ids, place = decode_block(table, block)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array(docs.data, pa.int64(), mask=docs.mask), pa.array(place + ends - lengths),
                     pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "within", "n_tokens", "ids_crc32"])

    got = blocks.select("part", "block").mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # a row for each written part, not for each document
    sums = blocks.groupBy("part").agg(F.sum("n").alias("_n"))
    base = sums.select(F.col("part").alias("_p"), (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_base"))
    return got.join(base, got["part"] == base["_p"]).select("doc_id", (F.col("_base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode all documents, write them as blocks and read the files back.

    Returns doc_id, start, n_tokens, ids_crc32.  A null or empty text is the
    end id alone; repeated doc_ids stay rows of their own, in a fixed order; a
    null doc_id sorts first and reads back as null; an empty table gives no
    rows; other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    out = path or ws.path("blocks")
    vocab = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    ids = ws.put(token_ids(docs, tokenizer, end_id), "ids")
    freq = quantised(frequencies(ids, vocab))
    write_blocks(ids, freq, out, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ws.drop("ids")
    return read_blocks(spark.read.parquet(out), freq)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_output(spark, sf_dir):
    return token_output(read(spark, sf_dir, "documents"), default_tokenizer(), 2)
