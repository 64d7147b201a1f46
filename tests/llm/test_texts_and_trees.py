"""Fingerprints, fill-in-middle and the Merkle manifest by brute force; what repeated and missing ids must not lose."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("slotwise.llm")

from slotwise.llm import common, decontaminate, fill_middle, fingerprints, line_dedup, merkle  # noqa: E402
from slotwise.llm.common import Workspace, read  # noqa: E402
from test_llm import EDGE, SCHEMA  # noqa: E402


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r[:4], *[r[4]] * 11) for r in EDGE], SCHEMA).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- fill-in-middle ----------------------------------------------------------------------------

@pytest.mark.parametrize("text", ["", " ", "  \t", "one", " one", "one ", "one two\n three  ", "\x0bé \U0001f600\U0001f600 x\x0c", "a b", "tail  \n"])
def test_units_end_where_the_pattern_ends(text):
    codes, at = fill_middle.boundaries(text)
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert at.tolist() == [0, *np.cumsum([len(u) for u in units])] if units else at.tolist() == [0]
    assert len(codes) == len(text)


@pytest.mark.parametrize("text", ["", "a", "a <P", "<S <S <S", "M> <M", "x y z <", "> <P S> q", "one two three four"])
def test_every_form_gives_the_text_back(text):
    seen = set()
    for i in range(200):
        out, n, form, low, middle = fill_middle.moved(text, i, changed=100, suffix_first=50)
        seen.add(form)
        assert fill_middle.put_back(out, form) == text
        assert (low is None) == (form == "plain") == (middle is None)
    assert seen == ({"plain"} if not text else {"psm", "spm"})


def test_texts_with_marks_stay(spark):
    for mark in ("<P>", "<S>", "<M>"):
        assert all(fill_middle.moved(f"a {mark} b", i, changed=100)[2] == "plain" for i in range(20))


def test_fill_in_middle_like_brute_force(spark, sf, docs):
    got = {r["doc_id"]: r for r in fill_middle.op12_fill_in_middle(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", r["text"])
        h = hashlib.sha256(f"42:{r['doc_id']}".encode()).hexdigest()
        a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        form, out = ("plain", r["text"]) if c % 100 >= 50 else ("spm", f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
        g = got[r["doc_id"]]
        assert (g["n"], g["form"], g["output_sha256"], g["restored_sha256"]) == (len(units), form, sha(out), sha(r["text"]))
        assert (g["prefix_chars"], g["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))


def test_fill_in_middle_of_edge_cases(edge):
    out = fill_middle.restored(fill_middle.fill_in_middle(edge, changed=100))
    assert out.columns[: len(edge.columns) - 1] == [c for c in edge.columns if c != "n"]
    rows = out.collect()
    assert Counter((r["doc_id"], r["restored"]) for r in rows) == Counter((r[0], r[1] or "") for r in EDGE)
    assert {r["doc_id"]: r["form"] for r in rows}[2] == "plain"
    assert fill_middle.fill_in_middle(edge.limit(0)).count() == 0


# --- Merkle manifest ---------------------------------------------------------------------------

def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 100])
def test_fragments_merge_in_any_order(n):
    leaves = [sha(str(i)) for i in range(n)]
    want = levels([levels(leaves)[-1][0], sha("other")])[-1][0]
    sizes = {0: n, 1: 1, merkle.TOP: 2}
    rng = np.random.default_rng(n)
    for _ in range(5):
        cuts = sorted(rng.integers(0, n + 1, 4).tolist())
        parts = [merkle.grown({(0, 0): dict(enumerate(leaves[a:b], a))}, sizes)[1] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        parts.append({(1, 0): {0: sha("other")}})
        order = rng.permutation(len(parts)).tolist()
        one = two = {}
        for k in order:
            one = merkle.merged(one, parts[k], sizes)
        for k in reversed(order):
            two = merkle.merged(parts[k], two, sizes)
        assert one == two == {(merkle.TOP, 1): {0: want}}


def test_fragments_hold_few_nodes():
    _, left = merkle.grown({(0, 0): {i: sha(str(i)) for i in range(1001, 3001)}}, {0: 10_000, merkle.TOP: 1})
    assert sum(len(x) for x in left.values()) <= 2 * 12


def model_manifest(rows):
    """{key of a row: (leaf, subroot, root, proof, folded root of the tampered leaf)} of rows (doc_id, source, lang, n_chars, text)."""
    def leaf(r, more=0):
        v = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: levels([leaf(r) for r in v]) for k, v in own.items()}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for at, k in enumerate(langs):
        for i, r in enumerate(own[k]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % merkle.TAMPERED == 0
            now, proof = leaf(r, int(hit)), []
            for tree, j in ((trees[k], i), (top, at)):
                for level in tree[:-1]:
                    pair = [now]
                    if j ^ 1 < len(level):
                        proof.append(level[j ^ 1])
                        pair = [level[j ^ 1], now] if j & 1 else [now, level[j ^ 1]]
                    now, j = sha(*pair), j // 2
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(*proof), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaves", "fan"), [(merkle.LEAVES, merkle.FAN), (5, 3)])
def test_manifest_like_brute_force(spark, sf, docs, monkeypatch, leaves, fan):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "FAN", fan)
    got = merkle.op13_merkle_manifest(spark, sf).collect()
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in docs.collect()]
    assert sorted((tuple(r) for r in got), key=str) == model_manifest([(a, b, c, d, e) for a, b, c, d, e in rows])
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_edge_cases(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 2)
    monkeypatch.setattr(merkle, "FAN", 2)
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in edge.collect()] + [(None, "a", None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    root = merkle.write_manifest(df, str(tmp_path / "m"))
    want = model_manifest(rows)
    got = spark.read.parquet(str(tmp_path / "m/rows"))
    assert root == want[0][3] and sorted(((r["doc_id"], r["leaf"], r["subroot"]) for r in got.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    checked = merkle.refolded(got, "leaf", root)
    assert checked.where("not verified").count() == 0 and sorted(r["proof_sha256"] for r in checked.collect()) == sorted(w[4] for w in want)
    one = merkle.write_manifest(df.limit(1), str(tmp_path / "one"))
    assert one == spark.read.parquet(str(tmp_path / "one/rows")).first()["leaf"]
    assert merkle.write_manifest(df.limit(0), str(tmp_path / "none")) is None and spark.read.parquet(str(tmp_path / "none/rows")).count() == 0


# --- fingerprints ------------------------------------------------------------------------------

def model_features(text, ranks):
    """Windows that are the rarest of often enough frames, by looking at every window and every frame."""
    raw = text.encode()
    rank = []
    for i in range(len(raw) - fingerprints.WINDOW + 1):
        s = sum(int(fingerprints._WORTH[c]) for c in Counter(raw[i : i + fingerprints.WINDOW]).values())
        b = (int(fingerprints._WORTH[-1]) - s) * fingerprints.BINS // int(fingerprints._WORTH[-1])
        rank.append(int(ranks[b]) if b >= fingerprints.WEAK else None)
    won = Counter()
    for j in range(1 - fingerprints.NEIGHBOURS, len(rank)):
        frame = [(rank[i], i) for i in range(max(0, j), min(len(rank), j + fingerprints.NEIGHBOURS)) if rank[i] is not None]
        if frame:
            won[min(frame)[1]] += 1
    found = [raw[i : i + fingerprints.WINDOW] for i in sorted(won) if won[i] >= fingerprints.OFTEN]
    return list(dict.fromkeys(found)) or ([raw] if raw else [])


SOME = ["", "a", "short text of few words", "x" * 500, "é“ü” \x1f   \U0001f600" * 12, " ".join(f"word{k * k % 97} of {k}" for k in range(150)), "the same line again\n" * 40]


@pytest.mark.parametrize("stretch", [fingerprints.STRETCH, 300])
def test_features_like_brute_force(docs, monkeypatch, stretch):
    monkeypatch.setattr(fingerprints, "STRETCH", stretch)
    ranks = fingerprints.rarity(docs)
    texts = SOME + [r["text"][:3000] for r in docs.orderBy("doc_id").limit(12).collect()]
    owner, h = fingerprints.features([t.encode() for t in texts], ranks)
    for i, t in enumerate(texts):
        want = model_features(t, ranks)
        got = h[owner == i].tolist()
        if len(want) == 1 and len(want[0]) != fingerprints.WINDOW:
            assert len(got) == 1
        else:
            raw = np.frombuffer(b"".join(want), np.uint8)
            assert got == fingerprints.window_hashes(raw, np.arange(len(want)) * fingerprints.WINDOW).tolist() if want else not got


def test_rarity_counts_every_window(docs):
    counts = Counter()
    for r in docs.limit(20).collect():
        raw = r["text"].encode()[:2000]
        for i in range(len(raw) - fingerprints.WINDOW + 1):
            s = sum(int(fingerprints._WORTH[c]) for c in Counter(raw[i : i + fingerprints.WINDOW]).values())
            counts[(int(fingerprints._WORTH[-1]) - s) * fingerprints.BINS // int(fingerprints._WORTH[-1])] += 1
    few = docs.limit(20).withColumn("text", F.expr("decode(substring(encode(text, 'UTF-8'), 1, 2000), 'UTF-8')"))
    few = few.where(F.octet_length("text") <= 2000)
    if few.count() == 20:
        ranks = fingerprints.rarity(few)
        order = sorted(range(fingerprints.BINS + 1), key=lambda b: (counts[b], b))
        assert [int(ranks[b]) for b in order] == list(range(fingerprints.BINS + 1))


def test_likeness():
    ranks = np.arange(fingerprints.BINS + 1, dtype=np.int32)
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    texts = [words(3000) for _ in range(4)]
    a, b, c, d = fingerprints.prints(texts, ranks)
    assert len(a.filters) > 1 and a.like(a) == 1 and a.like(b) < 0.05 and c.like(d) == d.like(c)
    half = fingerprints.prints([texts[0][: len(texts[0]) // 2]], ranks)[0]
    assert half.like(a) > 0.9 and a.like(half) == half.like(a)
    mixed = fingerprints.prints([fingerprints.edited(texts[0], texts[1])], ranks)[0]
    assert 0.65 < a.like(mixed) < 0.9 and 0.1 < b.like(mixed) < 0.4
    assert fingerprints.likeness(str(a), str(mixed)) == a.like(mixed) and str(fingerprints.Print.read(str(a))) == str(a)
    none, some = fingerprints.prints(["", "x"], ranks)
    assert none.like(none) == some.like(some) == 1 and none.like(some) == some.like(none) == 0 and str(none) == "0:"


def test_fingerprints_of_the_table(spark, sf, docs):
    got = sorted(fingerprints.op11_document_fingerprints(spark, sf).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ranks = fingerprints.rarity(docs)
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        following = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        new = t[: len(t) - k] + following[:k]
        own, other, after = fingerprints.prints([t, new, following], ranks)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == sha(new)
        assert (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == (str(own), str(other), own.like(other), own.like(after))
    assert np.mean([r["near_edited"] for r in got]) > 0.6 and np.mean([r["near_next"] for r in got]) < 0.1


def test_fingerprints_of_edge_cases(spark, edge):
    got = fingerprints.edits_compared(edge).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in EDGE)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[1][1]["fingerprint"] and by[2][0]["fingerprint"] == by[3][0]["fingerprint"] == "0:"
    assert by[2][0]["near_edited"] == 1 and by[2][0]["near_next"] == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    # the last one is followed by the one without an id
    first = next(r[1] for r in EDGE if r[0] is None)
    last = next(r[1] for r in EDGE if r[0] == 7)
    assert by[7][0]["edited_sha256"] == sha(fingerprints.edited(last, first))
    assert fingerprints.edits_compared(edge.limit(0)).count() == 0
    one = fingerprints.edits_compared(edge.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    out = fingerprints.fingerprinted(edge)
    assert out.columns == [*edge.columns, "fingerprint"] and out.count() == len(EDGE)


# --- rows of one id, rows without one ------------------------------------------------------------

def test_line_dedup_keeps_each_rows_own_lines(spark):
    rows = [(1, "alpha beta\nsecond line"), (1, "alpha beta\nsecond line"), (2, "x y z\nkeep me alone"), (2, "unique first line\nx y z"), (None, "x y z\nmine"), (None, "x y z\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = Counter()
    for r in line_dedup.line_dedup(df).collect():
        lines += Counter(x for x in r["text"].split("\n") if x)
    assert lines == Counter(["alpha beta", "second line", "x y z", "keep me alone", "unique first line", "mine", "other"])


def test_lines_without_an_id_take_linear_time(spark):
    def took(df):
        began = time.perf_counter()
        n = line_dedup.line_decisions(df).agg(F.sum(F.size("dropped"))).first()[0]
        return time.perf_counter() - began, n

    text = F.concat_ws(" ", *(F.sha1(F.concat(F.col("id").cast("string"), F.lit(k)).cast("binary")) for k in "abcdef"), F.lit("end"))
    base = spark.range(10_000).select("id", text.alias("text"))
    near = base.select("id", F.regexp_replace("text", "end$", "fin").alias("text"))
    both = base.select("text").union(near.select("text"))
    took(both.limit(10).withColumn("doc_id", F.lit(None).cast("long")))
    with_ids, n = took(both.withColumn("doc_id", F.monotonically_increasing_id()))
    without, m = took(both.withColumn("doc_id", F.lit(None).cast("long")))
    assert n == m == 10_000 and without < 5 * with_ids + 5


def test_passes_give_the_same_rows(spark, sf, docs, monkeypatch):
    some = read(spark, sf, "benchmark")
    t = [r["text"] for r in some.where("length(text) > 60").orderBy("item_id").limit(3).collect()]
    bench = spark.createDataFrame([(1, t[0]), (1, t[1]), (2, t[2]), (1, t[0])], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"before it {t[0]} and {t[1]} after it"), (2, t[1]), (3, "nothing of it"), (4, f"{t[2]} {t[0]}")], "doc_id long, text string")
    rows = lambda: sorted((r["doc_id"], [(x["item_id"], x["similarity"]) for x in r["items"]]) for r in decontaminate.contamination(texts, bench).collect())
    once = rows()
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 1)
    assert rows() == once and [len(x) for _, x in once] == [1, 1, 0, 2]


def test_labelled_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    docs = spark.range(20).crossJoin(spark.range(50).select(F.col("id").alias("k"))).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "k").alias("text"))
    got = common.labelled_sample(docs, labels, "quality", 3)
    assert len(got) == 6 and Counter(y for _, y in got) == {0: 3, 1: 3} and got == common.labelled_sample(docs.repartition(3), labels, "quality", 3)
    assert [r[0] for r in spark.createDataFrame([(None,), (1,)], "doc_id long").select(common.held_out(F.col("doc_id"))).collect()].count(None) == 0


def test_workspaces_leave_nothing(spark, edge):
    ws = Workspace(spark, "nothing")
    merkle.manifest(merkle.row_leaves(edge), ws)
    ws.close()


def test_manifest_over_many_tasks(spark, sf, monkeypatch):
    """Fragments and their paths meet by equal keys also where no tasks are put together."""
    monkeypatch.setattr(merkle, "FAN", 4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = merkle.op13_merkle_manifest(spark, sf).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in read(spark, sf, "documents").collect()]
    assert sorted((tuple(r) for r in got), key=str) == model_manifest(rows)
