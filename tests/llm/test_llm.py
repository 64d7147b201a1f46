"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("slotwise.llm")

from slotwise.llm import common, decontaminate, embedding_dedup, licenses, line_dedup, minhash, mixing, quality, secrets, token_output, toxicity  # noqa: E402
from slotwise.llm.common import hashed_words, read, shingle_hashes  # noqa: E402
from slotwise.llm.queries import queries  # noqa: E402

LONG = "long words of text " * 6000
EDGE = [
    (1, "one two three four five six\nshared line of exactly seven words here", "en", "a", "x"),
    (1, "one two three four five six\nshared line of exactly seven words here", "en", "a", "x"),
    (2, None, "en", None, "y"), (3, "", None, "a", None), (4, "   \n\t", "en", "b", "z"), (None, "a text without an id", "en", "b", "z"),
    (5, LONG, "en", "a", "x"), (6, "shared line of exactly seven words there\n…!?", "de", "c", "x"), (7, "é“ü” \x1f   \U0001f600", "fr", "c", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, score string, key string, rep string, row string, line string, size string, n string, _id string, comp string, content string, target string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    return spark.createDataFrame([(*r[:4], *[r[4]] * 11) for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


def components(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("hot", [3, 2000])
def test_components_by_joins_with_and_without_hot_nodes(spark, monkeypatch, hot):
    """Where no node has many neighbours no rows are dealt by salts, which takes two more joins each time."""
    dealt = []
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "to_hot", lambda *x, f=common.to_hot: dealt.append(1) or f(*x))
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200, i) for i in range(150, 200)] + [(7, 7)]
    ws = common.Workspace(spark, "test")
    got = {r["id"]: r["comp"] for r in common.connected_components(ws, spark.createDataFrame(links, "a long, b long"), "x").collect()}
    none = common.connected_components(ws, spark.createDataFrame([(1, 1)], "a long, b long"), "y").count()
    ws.close()
    want = components(201, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}} and none == 0
    assert bool(dealt) == (hot == 3)


# --- line dedup ------------------------------------------------------------------------------

def model_lines(rows):
    """Dropped lines of (doc_id, text) in order, by comparing each line with all before it."""
    seen, out = [], []
    for _, text in rows:
        drop = []
        for k, line in enumerate((text or "").split("\n")):
            h = hashed_words([line])[0]
            if len(h):
                if any(np.array_equal(h, x) or min(len(h), len(x)) >= line_dedup.LEAST_WORDS and line_dedup.one_word_apart(h, x) for x in seen):
                    drop.append(k)
                seen.append(h)
        out.append(drop)
    return out


def test_one_word_apart():
    a = np.arange(6)
    assert line_dedup.one_word_apart(a, a) and line_dedup.one_word_apart(a, np.delete(a, 2)) and line_dedup.one_word_apart(np.delete(a, 5), a)
    assert line_dedup.one_word_apart(a, np.r_[a[:3], 99, a[4:]]) and line_dedup.one_word_apart(a, np.r_[a[:5], 99])
    assert not line_dedup.one_word_apart(a, a[::-1]) and not line_dedup.one_word_apart(a, np.r_[98, a[1:5], 99]) and not line_dedup.one_word_apart(a, a[:4])


def test_lines_like_brute_force(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_decisions(docs).collect()}
    assert [got[i] for i, _ in rows] == model_lines(rows)


def test_lines_of_edge_cases(edge):
    got = line_dedup.line_decisions(edge).collect()
    by = sorted((r["doc_id"] or 0, r["n_lines"], r["n_kept"]) for r in got)
    assert by == [(0, 1, 1), (1, 2, 0), (1, 2, 2), (2, 1, 1), (3, 1, 1), (4, 2, 2), (5, 1, 1), (6, 2, 1), (7, 1, 1)]
    out = line_dedup.line_dedup(edge)
    assert out.columns == edge.columns and {r["doc_id"]: r["text"] for r in out.collect()}[6] == "…!?"
    assert line_dedup.line_decisions(edge.limit(0)).count() == 0


# --- MinHash ---------------------------------------------------------------------------------

def test_dart_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for share in (10, 60, 150):
        b = a.copy()
        b[:share] = rng.integers(0, 2**63, share, dtype=np.uint64)
        b = np.r_[b, b[-20:]]  # weights over one
        s = minhash.signatures([a, b], 2000)
        assert (s[0] == s[1]).mean() == pytest.approx(minhash.jaccard(minhash.units_of(a), minhash.units_of(b)), abs=0.05)


def test_near_duplicates_like_brute_force(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    own = [Counter(minhash.elements(t).tolist()) for _, t in rows]

    def similar(a, b):
        both = sum((a & b).values())
        return both / (sum(a.values()) + sum(b.values()) - both) >= 0.8 if a and b else False

    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(own[i], own[j])])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]


def test_a_bucket_that_stays_apart_is_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.choice(120, 4 + i % 6, replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = [minhash.units_of(minhash.elements(t)) for _, t in rows]
    want = components(40, [(i, j) for i in range(40) for j in range(i) if minhash.jaccard(own[i], own[j]) >= 0.6])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, 0.6).collect()}
    assert [got[i] for i in range(40)] == want


def test_near_duplicates_of_edge_cases(edge):
    got = sorted((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in minhash.near_duplicates(edge).collect())
    assert [x[0] for x in got] == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(c == i and k for i, c, k in got if i)
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_with_shared_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (None, a + " more"), (None, c), (None, c + " more"), (3, None)]
    got = sorted(((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (0, 1, False), (0, None, True), (0, None, True), (3, 3, True)], key=str)


# --- token output ----------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 300_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 49407).astype(np.uint32)
    table = token_output.Table(token_output.quantised(np.bincount(ids, minlength=49408)))
    lengths = np.diff(np.r_[0, np.sort(rng.integers(0, n + 1, 9)), n])
    block = token_output.encode_block(table, list(range(10)), lengths, ids, 17)
    docs, got_lengths, got, place = token_output.decode_block(table, block)
    assert place == 17 and docs.tolist() == list(range(10)) and (got_lengths == lengths).all() and (got == ids).all()
    row = token_output.LANES * token_output.ROWS_BETWEEN
    if n > row:
        assert (token_output.decode_block(table, block, 1)[2] == ids[row:]).all()
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_output.decode_block(table, bytes(broken))


def test_readers_share_a_block():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 500, 5 * token_output.LANES * token_output.ROWS_BETWEEN + 77).astype(np.uint32)
    table = token_output.Table(token_output.quantised(np.bincount(ids)))
    block = token_output.encode_block(table, [1, None, -(2**63)], np.array([5, 0, len(ids) - 5]), ids, 0)
    docs, _, whole, _ = token_output.decode_block(table, block)
    assert docs.tolist() == [1, None, -(2**63)] and (whole == ids).all()
    parts = [token_output.decode_block(table, block, a, b)[2] for a, b in ((0, 1), (1, 4), (4, 5), (5, None))]
    assert (np.concatenate(parts) == ids).all()


def test_quantised_keeps_every_id():
    counts = np.r_[10**12, np.ones(49000, np.int64), 0]
    f = token_output.quantised(counts)
    assert int(f.sum()) == 1 << token_output.SCALE and (f[:-1] > 0).all() and f[-1] == 0


def test_tokens_like_the_library(docs, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.default_tokenizer())
    for df in (docs, edge):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"] or "") for r in df.select("doc_id", "text").collect())
        start, want = 0, []
        for i, t in rows:
            ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.token_output(df, token_output.default_tokenizer(), 2).collect())
        assert got == sorted(want)
    least = edge.sparkSession.createDataFrame([(-(2**63), "a"), (None, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in token_output.token_output(least, token_output.default_tokenizer(), 2).collect()} == {-(2**63), None}
    assert token_output.token_output(edge.limit(0), token_output.default_tokenizer(), 2).count() == 0


def test_encoder_on_odd_texts():
    e = token_output.Encoder(token_output.default_tokenizer(), 2)
    odd = ["a|b || |c", "<|startoftext|>A.B. É. x'S ... ,. “q” İ ñ́ ſ", "", " ", "a b\x1cc", "x., y.. z é. ß, µ. ", "A, b. C", LONG, "Σας ΑΣ"]
    assert [x[:-1].tolist() for x in e(odd)] == [e.ids(t) for t in odd]
    e.CACHE = 1
    assert [x[:-1].tolist() for x in e(odd)] == [e.ids(t) for t in odd]


# --- classifiers -----------------------------------------------------------------------------

@pytest.mark.parametrize(("op", "label"), [("op4_quality_classifier", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_accuracy(spark, op, label):
    sf = "/root/testdata/sf0.01"
    got = queries()[op](spark, sf).where("held_out").join(read(spark, sf, "labels"), "doc_id").where(F.col(label).isNotNull())
    n, right = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col(label))).first()
    assert n > 50 and right / n >= 0.93
    assert queries()[op](spark, sf).where("score is null or score < 0 or score > 1").count() == 0


def test_classifiers_on_edge_cases(spark, edge):
    labels = spark.createDataFrame([(i, None if i == 9 else i % 2, i % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        out = quality.score(edge, quality.fit(edge, labelled))
        assert out.count() == 9 and out.where("score between 0 and 1").count() == 9 and set(out.columns) == set(edge.columns)
        assert toxicity.score(edge, toxicity.fit(edge, labelled)).where("score between 0 and 1").count() == 9
    assert quality.score(edge.limit(0), quality.fit(edge, labels)).count() == 0


def test_compressed_sizes_like_the_library(docs):
    import zstandard as zs

    texts = [r["text"] for r in docs.limit(60).collect()]
    good, bad = quality.dictionary(texts[:30]), quality.dictionary(texts[30:])
    c = quality.Compressors(good, bad)
    for t in [*texts, "", "é" * 5000, LONG]:
        raw = t.encode()
        sizes = []
        for d in (good, bad):
            z = zs.ZstdCompressor(level=3, dict_data=zs.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE)))
        g, b = sizes
        assert c.features(t) == pytest.approx((1.0, 10 * (g - b) / max(1, g + b), 10 * (g - b) / max(1, len(raw))))


def test_score_is_the_calibrated_difference(edge):
    labels = edge.sparkSession.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, quality int")
    model = quality.fit(edge, labels)
    c = quality.Compressors(*model[:2])
    for r in quality.score(edge, model, "_p").collect():
        assert r["_p"] == pytest.approx(1 / (1 + np.exp(-float(np.dot(c.features(r["text"]), model[2])))))


def test_log_odds_and_decay_like_their_formulas():
    import math

    toxic = [[f"a{i}", "bad", f"b{i}", "worse", "the"] for i in range(60)] + [[f"a{i}", "bad", "x"] for i in range(60, 90)]
    copied = [["some", "copied", "passage", "here", f"c{i}"] for i in range(40)]
    clean = [["the", "good", "y"], ["the", "x", "fine"]] * 60
    got = toxicity.log_odds(toxic + copied, clean, 2.0)
    assert set(got) == {"bad", "worse"}  # a passage that is copied is one text
    n, m = len(toxic) + len(copied), len(clean)
    for w, ya in (("bad", 90), ("worse", 60)):
        prior = toxicity.PRIOR * ya / (n + m) + 0.01
        odds = math.log((ya + prior) / (n + 2 * toxicity.PRIOR - ya)) - math.log(prior / (m + 2 * toxicity.PRIOR))
        assert got[w] == pytest.approx(odds - math.sqrt(1 / (ya + prior) + 1 / prior))
    rate = toxicity.decay(got, clean)
    total = sum(map(len, clean)) + len(got)
    p = {w: 0.5 / total for w in got}
    assert (1 - sum(p.values())) * math.exp(-rate) + sum(q * math.exp(rate * got[w]) for w, q in p.items()) == pytest.approx(1.0, abs=1e-6)


def test_tokens_are_whole_words():
    assert toxicity.tokens("Assassin assay, ASSAULT\n坏人 x_1") == ["assassin", "assay", "assault", "坏", "人", "x_1"]
    assert toxicity.tokens(None) == []


def test_segments_like_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        gain = {i: float(rng.integers(1, 6)) for i in range(n) if rng.random() < 0.4}
        s = [gain.get(i, -1.0) for i in range(n)]

        def maximal(lo, hi, s=s):
            """The best-scoring run, shortest first, then left and right of it."""
            best = max(((sum(s[a:b]), a - b, -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            a, b = -best[2], best[3]
            return [*maximal(lo, a), (a, b), *maximal(b, hi)]

        got = toxicity.segments(sorted(gain), [gain[i] for i in sorted(gain)])
        assert sum(x[2] for x in got) == pytest.approx(sum(sum(s[a:b]) for a, b in maximal(0, n)))


# --- secrets ---------------------------------------------------------------------------------

def test_secrets_like_their_patterns(docs, edge):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for df in (docs, edge):
        want = []
        for r in df.collect():
            t = r["text"] or ""
            base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
            base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
            base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base))
            want.append((r["doc_id"] or 0, *[sum(k == x for _, k, _ in base) for x in range(3)], hashlib.sha256(said.encode()).hexdigest()))
        got = [(r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.secret_scan(df).collect()]
        assert sorted(got) == sorted(want)


def test_guess_costs():
    b = secrets.guess_bits
    assert b("") == 0 and b("password123") < b("x9F!kQ2#pLz8") and b("qwertyuiop") < 20 and b("aaaaaaaaaaaa") < 15 and b("2024-01-05") < 20 and b("abcabcabcabc") < 20
    assert b("x9F!kQ2#pLz8") > secrets.LEAST_BITS
    assert [k for _, k, _ in secrets.spans_of('pwd: "x9F!kQ2#pLz8" and pwd: password1')[1]] == [3]
    assert secrets.spans_of("secret=token = abcdefgh")[0] == []


def cheapest(value, ranks):
    """The minimum over all segmentations of a short value, part by part."""
    from functools import cache

    low, n = value.lower(), len(value)
    per = secrets.brute_bits(value) / n

    def options(i, j):
        part = value[i:j]
        yield 1 + per * (j - i)
        for form, more in ((low[i:j], 0.0), (low.translate(secrets.LEET)[i:j], 2.0)):
            if len(part) >= 3 and form in ranks:
                case = 0.0 if part == low[i:j] else 1.0 if part[1:] == low[i + 1 : j] else float(j - i)
                yield 1 + np.log2(ranks[form] + 1) + case + (more if low[i:j] not in ranks else 0.0)
                break
        m = secrets.DATE.match(value, i)
        if m and m.end() == j:
            yield 1 + np.log2(365 * 120) + 2
        if j - i >= 3 and len(set(part)) == 1:
            yield 1 + per + np.log2(j - i)
        for width in range(2, 9):
            k = (j - i) // width
            if k >= 2 and k * width == j - i and part == part[:width] * k:
                yield 1 + width * per + np.log2(k)
        steps = [ord(b) - ord(a) for a, b in zip(low[i:j], low[i + 1 : j], strict=False)]
        linked = [b in secrets.NEAR.get(a, ()) or (abs(ord(b) - ord(a)) == 1 and a.isalnum() and b.isalnum()) for a, b in zip(low[i:j], low[i + 1 : j], strict=False)]
        if j - i >= 3 and all(linked):
            turns = sum(x != y for x, y in zip([0, *steps], steps, strict=False))
            yield 1 + np.log2(47) + 2 * turns + np.log2(j - i)

    @cache
    def best(i):
        return 0.0 if i == n else min(min(options(i, j)) + best(j) for j in range(i + 1, n + 1))

    return best(0)


def test_guess_costs_are_the_cheapest_segmentation():
    rng = np.random.default_rng(3)
    ranks = {**secrets.RANK, "haus": 400, "sternwarte": 9000}
    parts = ["haus", "Haus", "sternwarte", "pa55word", "qwer", "123", "aaaa", "abab", "2024-01-05", "K#", "x", "zxcv", "7", "HAUS"]
    for _ in range(150):
        value = "".join(rng.choice(parts, rng.integers(1, 4)))[:14]
        want = cheapest(value, ranks)
        assert secrets.guess_bits(value, ranks) == pytest.approx(want), value
        for limit in (10.0, 30.0, 60.0):
            assert (secrets.guess_bits(value, ranks, limit) >= limit) == (want >= limit)


def test_words_of_the_corpus_are_cheap(spark):
    import time

    common = "information schmetterling mountainriver international quelquefois mariposa required".split()
    rows = [(i, f"there is {' and '.join(common)} {i}") for i in range(30)] + [(100 + i, f"pwd: {w}") for i, w in enumerate(common)]
    rows += [(200, "pwd: xkqzvbnwpyjd"), (201, "pwd: x9F!kQ2#pLz8"), (202, "pwd: " + "x9F!kQ2#pLz8" * 90_000), (203, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = secrets.word_ranks(df)
    assert all(secrets.guess_bits(w, ranks) < secrets.LEAST_BITS for w in common) and secrets.guess_bits("information") > secrets.LEAST_BITS
    began = time.perf_counter()
    got = {r["doc_id"]: r["n_guess"] for r in secrets.secret_scan(df).collect()}
    assert time.perf_counter() - began < 30
    assert {i for i, n in got.items() if n} == {200, 201, 202}
    assert secrets.secret_scan(df.limit(0)).count() == 0


def test_values_that_go_on_after_a_base_span():
    text = "password: Summer2024!xK#9vQ and more"
    base, every = secrets.spans_of(text)
    assert base == [(0, 0, 20)] and every == [*base, (10, 3, 27)] and text[10:27] == "Summer2024!xK#9vQ"
    for t in ("f(password=k3Jx9Qm2Vb7Zt)", "api_key: k3Jx9Qm2Vb7Zt", "token: password!", "token=aaaaaa!"):
        assert [k for _, k, _ in secrets.spans_of(t)[1]] == [0]
    assert secrets.spans_of("pwd: #" + "0123456789abcdef" * 2)[1][0][1:] == (3, 38)


# --- licences --------------------------------------------------------------------------------

def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"
    rows = [(1, "p/LICENSE", mit), (2, "p/src/a.py", "code\n# Licensed under the Apache License, Version 2.0.\nmore"), (3, "p/src/deep/b.py", "code"), (4, "q/c.py", "no rights to a licence here"), (5, None, None), (5, "p/d", "")]
    got = {(r["id"], r["license"], r["basis"], r["directory"]) for r in licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {(1, "MIT", "file", None), (2, "Apache-2.0", "header", None), (3, "MIT", "inherited", "p"), (4, None, "none", None), (5, None, "none", None), (5, "MIT", "inherited", "p")}


def test_whole_and_wrapped_licences(spark):
    from slotwise.llm.license_texts import BODIES

    code = "".join(f"value_{i} = compute_{i}(other_{i})\n" for i in range(60))
    owner = "Copyright (c) 2024 Jane Doe and others\n\n"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n"
    apache = 'Copyright 2020 Jane Doe. All rights reserved.\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n'

    def marked(mark, t):
        return "".join(f"{mark} {line}\n" for line in t.split("\n")) + code

    rows = [(owner + t, n, "file") for n, t in BODIES.items()]
    rows += [(" ".join(BODIES["MIT"].split()), "MIT", "file"), (marked("#", gpl), "GPL-3.0", "header"), (marked(" *", gpl), "GPL-3.0", "header"), (marked("dnl", gpl), "GPL-3.0", "header"), (marked("//", apache), "Apache-2.0", "header")]
    rows += [(marked("#", owner + BODIES[n]), n, "header") for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")]
    rows += [(marked("#", "It reads tables of many kinds and writes them. Licensed under\nthe MIT\nLicense. See elsewhere for what else it does with its own tables."), "MIT", "header")]
    tags = [("// SPDX-License-Identifier: MIT\n", "MIT"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */\n", "GPL-3.0"), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "(MIT OR Apache-2.0)"), ("<!--SPDX-License-Identifier: Zlib-->\n", "Zlib"), ('"license": "mpl-2.0",\n', "MPL-2.0")]
    rows += [(t + code, n, "header") for t, n in tags]
    rows += [(t + code, None, "none") for t in ("license: see file\n", "SPDX-License-Identifier: NONE\n", "the rights of\nall who read\n")]
    plain = [(1000 + i, None, f"{code} some more words {i}") for i in range(60)]
    files = spark.createDataFrame([(i, None, t) for i, (t, _, _) in enumerate(rows)] + plain, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["basis"]) for r in licenses.license_scan(files).collect()}
    assert [got[i] for i in range(len(rows))] == [(n, b) for _, n, b in rows]
    assert all(got[i] == (None, "none") for i, _, _ in plain)


def test_licences_wherever_they_stand(spark):
    from slotwise.llm.license_texts import BODIES

    words = " ".join(f"word{i}" for i in range(150))
    rows = [
        (1, None, f"{words} Licensed under the Apache License, Version 2.0 {words}"), (2, None, f"{words} {' '.join(BODIES['MIT'].split())} {words}"), (3, None, ""), (4, None, words * 400),
        (5, "a/LICENSE", BODIES["MIT"]), (6, "a/COPYING", BODIES["ISC"]), (7, "a/b/c/d.py", "code"), (7, "a/b/c/d.py", "code"), (8, None, "Dies Werk steht unter Released under the MIT License. und mehr"), (9, "", None)]
    df = spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], "id long, path string, text string, license string, basis string, score double")
    got = sorted((r["id"], r["license"], r["basis"], r["directory"]) for r in licenses.license_scan(df).collect())
    assert [x[:3] for x in got] == [
        (1, "Apache-2.0", "header"), (2, "MIT", "header"), (3, None, "none"), (4, None, "none"), (5, "MIT", "file"), (6, "ISC", "file"),
        (7, got[6][1], "inherited"), (7, got[6][1], "inherited"), (8, "MIT", "header"), (9, None, "none")]
    assert got[6][1] in ("MIT", "ISC") and got[6][3] == "a"
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_pruned_windows_like_all_windows():
    """The pruned search against the cosine of every window of joined units, by its definition."""
    import math

    rng = np.random.default_rng(5)
    m = licenses.Matcher(1000, {})
    t = m.notices
    pool = [w for _, x in licenses.TEMPLATES for w in licenses.words_of(x)]
    for _ in range(25):
        name, notice = licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))]
        noise = lambda n: " ".join(rng.choice([*pool, *(f"z{i}" for i in range(40))], n))
        kept = [w for w in notice.split() if rng.random() < 0.9]
        text = f"{noise(9)}.\n# {' '.join(kept)}\n{noise(30)}"
        lines = list(licenses.units(text))
        best = 0.0
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                words = [w for line in lines[s:e] for w in line]
                v = Counter(words)
                norm = math.sqrt(sum((n * t.idf.get(w, t.other)) ** 2 for w, n in v.items()))
                best = max([best, *(sum(n * t.idf.get(w, t.other) * x.get(w, 0.0) for w, n in v.items()) / norm for x in t.vectors)])
        kind, score, _ = m.scan(text)
        assert (kind != "none") == (best >= licenses.LEAST - 1e-12) and (kind != "header" or abs(score - best) < 1e-9)


# --- embeddings ------------------------------------------------------------------------------

def test_embeddings_like_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, sf, "embeddings").collect()]
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 64))
    extra = [(10_000 + i, (base[i % 30] + rng.standard_normal(64) * 0.02 * (i % 12)).tolist()) for i in range(400)]
    odd = [(20_001, None), (20_002, [0.0] * 64), (20_003, [float("nan")] * 64), (20_004, [1.0, None] + [0.0] * 62), (20_005, []), (20_006, rows[0][1]), (20_006, rows[0][1]), (20_007, [3.0, 4.0]), (None, rows[0][1])]
    every = [*rows, *extra, *odd]
    df = spark.createDataFrame(every, "vec_id long, embedding array<float>").withColumn("label", F.lit("x"))
    good = {i: np.array(v, np.float32).astype(float) for i, v in every if i is not None and v and None not in v and all(np.isfinite(v)) and any(v)}
    ids = sorted(i for i in good if len(good[i]) == 64)
    u = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = u @ u.T >= 0.95
    comp = components(len(ids), list(zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    want = {i: (int(near[k].sum()) - 1, ids[comp[k]]) for k, i in enumerate(ids)}
    got = embedding_dedup.embedding_duplicates(df).collect()
    assert len(got) == len(every)
    total = sum(n for n, _ in want.values())
    found = sum(r["n_links"] for r in got if r["vec_id"] in want and r["vec_id"] != 20_006)
    assert found + want[20_006][0] >= 0.999 * total  # recall of the index
    assert all(r["n_links"] <= want.get(r["vec_id"], (0, 0))[0] for r in got)
    assert sum((r["component_id"] == want[r["vec_id"]][1]) for r in got if r["vec_id"] in want) >= 0.995 * len(ids)
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("d", [384, 768])
def test_recall_at_larger_dimensions(spark, d):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((60, d))
    # cosines around the threshold and above, in groups of unequal sizes; some vectors huge or tiny
    v = [base[i % 60] / np.linalg.norm(base[i % 60]) + rng.standard_normal(d) * (0.05 + 0.2 * (i % 7) / 7) / np.sqrt(d) for i in range(700)]
    scale = {0: 1e170, 1: 1e-170}
    rows = [(i, (x * scale.get(i % 50, 1.0)).tolist(), "x", "y") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, component_id string")
    u = np.array([x / np.linalg.norm(x) for x in v])
    near = u @ u.T >= 0.95
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_duplicates(df).collect()}
    want = near.sum(axis=1) - 1
    assert sum(got[i]["n_links"] for i in range(len(v))) >= 0.999 * want.sum() > 0
    assert all(got[i]["n_links"] <= want[i] for i in range(len(v)))


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 50])
def test_near_copies_are_no_rows_of_pairs(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    v = np.array([*(base + rng.standard_normal((500, 64)) * 0.05), *rng.standard_normal((100, 64))]).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    rows, put = {}, embedding_dedup.Workspace.put

    def counted(self, df, name):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(embedding_dedup.Workspace, "put", counted)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert [got[i] for i in range(600)] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()
    # a few rows a vector and piece, whatever the group's size
    assert max(rows.values()) <= (100 if block == 50 else 20) * 600


def test_pairs_that_eight_bits_leave_open_are_compared_exactly(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((150, 64))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    # cosines from 1e-4 below to 1e-4 above the least
    c = (0.95 + np.linspace(-1e-4, 1e-4, 150))[:, None]
    v = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert not any(got[i] for i in range(75))
    assert sum(got[i] for i in range(75, 150)) >= 74


# --- decontamination -------------------------------------------------------------------------

def test_contamination_like_brute_force(spark, sf, docs):
    bench = read(spark, sf, "benchmark")
    items = {r["item_id"]: shingle_hashes(hashed_words([r["text"]])[0], 5) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        h = shingle_hashes(hashed_words([r["text"]])[0], 5)
        hit = set()
        for i, x in items.items():
            if not len(x):
                continue
            c = Counter(x.tolist())
            for s in np.flatnonzero(np.isin(h, x)):
                for at in range(max(0, s - len(x) + 1), min(s, len(h) - len(x)) + 1):
                    both = sum((c & Counter(h[at : at + len(x)].tolist())).values())
                    if both / (2 * len(x) - both) >= 0.8:
                        hit.add(i)
        want[r["doc_id"]] = sorted(hit)
    got = {r["doc_id"]: sorted(x["item_id"] for x in r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == want and any(want.values())


def test_contamination_of_edge_cases(spark, edge, monkeypatch):
    bench = spark.createDataFrame([(1, "shared line of exactly seven words here"), (1, "shared line of exactly seven words here"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    got = [(r["doc_id"], r["contaminated"]) for r in decontaminate.contamination(edge, bench).collect()]
    assert sorted(i for i, c in got if c) == [1, 1] and len(got) == 9
    assert decontaminate.contamination(edge, bench.limit(0)).where("contaminated").count() == 0
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 1)
    assert {r["doc_id"] for r in decontaminate.contamination(edge, bench).where("contaminated").collect()} == {1}


def test_texts_shorter_than_items(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([44, 44, 30, 12, 9, 300])] + [(6, "tiny item here"), (7, "word")]
    texts = [" ".join(t.split()[:-cut or None]) for _, t in items[:6] for cut in (0, 1, 2, 3, 5, 8, 12)] + [" ".join(t.split()[2:]) for _, t in items[:6]]
    texts += [items[0][1] + " and more", "one tiny item here and there", "tiny item", "tiny item here", "a word", "wor", "here tiny item"]

    def runs(t, n):
        w = t.split()
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def similarity(text, item):
        w, x = text.split(), item.split()
        n = min(5, len(x))
        best, own = 0.0, runs(item, n)
        for at in range(max(1, len(w) - len(x) + 1)):  # a shorter text is the one window
            h = runs(" ".join(w[at : at + len(x)]), n)
            both = sum((h & own).values())
            best = max(best, both / (sum(h.values()) + sum(own.values()) - both))
        return best

    want = [{i for i, item in items if similarity(t, item) >= 0.8} for t in texts]
    got = decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [{x["item_id"] for x in r["items"]} for r in sorted(got, key=lambda r: r["doc_id"])] == want
    assert want[1] == want[2] == {0} and want[6] == set()


def blocks_of(rng, n):
    h = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(n)]
    prints = np.concatenate([decontaminate.window_prints(decontaminate.bit_sums(x), 40, np.zeros(1, np.int64)) for x in h])
    return decontaminate.Blocks(prints, np.arange(n) % 2)


def test_near_fingerprints_are_never_missed():
    rng = np.random.default_rng(6)
    t = blocks_of(rng, 30)
    for k in range(300):
        flips = rng.choice(decontaminate.BITS, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        bits = np.zeros(decontaminate.BITS, np.uint8)
        bits[flips] = 1
        other = t.prints[k % 30] ^ np.packbits(bits).view(np.uint64)
        assert (k % 30) in t.candidates(other[None, :], np.array([k % 2]))[1].tolist()
        assert (k % 30) not in t.candidates(other[None, :], np.array([1 - k % 2]))[1].tolist()


def test_few_pairs_are_candidates():
    rng = np.random.default_rng(9)
    t = blocks_of(rng, 200)
    h = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    prints = decontaminate.window_prints(decontaminate.bit_sums(h), 40, np.arange(0, 3900))
    pairs, size = len(prints) * 100, np.zeros(len(prints), np.int64)
    assert sum(len(w) for w, _ in t.looked_up(prints, size)) < 0.2 * pairs
    assert len(t.candidates(prints, size)[0]) < 0.0001 * pairs


def test_similar_windows_are_in_the_radius():
    """Multisets of similarity 0.8: what the radius misses of them."""
    rng = np.random.default_rng(12)
    missed = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 45, dtype=np.uint64)
        b = np.r_[a[:40], rng.integers(0, 2**63, 5, dtype=np.uint64)]
        x, y = (decontaminate.window_prints(decontaminate.bit_sums(h), 45, np.zeros(1, np.int64)) for h in (a, b))
        missed += int(np.bitwise_count(x ^ y).sum()) > decontaminate.RADIUS
    assert missed <= 1


def test_passes_over_a_large_benchmark(spark, sf, docs, monkeypatch):
    bench = read(spark, sf, "benchmark")
    twice = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))

    def rows():
        return sorted((r["doc_id"] or -1, [(x["item_id"], round(x["similarity"], 6)) for x in r["items"]]) for r in decontaminate.contamination(twice, bench).collect())

    want = rows()
    for most in (1 + bench.count() // 3, max(1, bench.count() // 8)):
        monkeypatch.setattr(decontaminate, "MOST_ITEMS", most)
        assert rows() == want


# --- mixing ----------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutations(n):
    p = mixing.Permutation(n, 3, 1)
    x = p(np.arange(n))
    assert sorted(x) == list(range(n)) and (p(x, back=True) == np.arange(n)).all()


def test_targets_by_resharing(spark):
    sizes = {f"s{i:02d}": s for i, s in enumerate([5, 1000, 3, 70, 0, 40, 900, 12])} | {None: 55}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = [*sorted(k for k in sizes if k), None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            break
        target |= {k: 3.0 * sizes[k] for k in over}
        left -= sum(3.0 * sizes[k] for k in over)
        free -= over
    target |= share
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in target.items()}


def test_mix_meets_its_targets(docs, edge):
    for df in (docs, edge):
        got = mixing.mixing(df).collect()
        assert len(got) == df.count() and all(r["taken"] <= 3 * r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault((r["source_size"], r["target"]), [0, 0])[0] += r["taken"]
            by[r["source_size"], r["target"]][1] += r["size"]
        for (size, target), (taken, own) in by.items():
            k = max(1, round(own / size)) if size else 1  # sources of the same size and target
            assert abs(taken - k * target) <= k
        key = lambda r: (r["doc_id"] or 0, r["size"], r["taken"])
        assert sorted(map(key, got)) == sorted(map(key, mixing.mixing(df).collect()))
    assert {r["doc_id"] or 0: r["size"] for r in mixing.mixing(edge).collect()} == {i or 0: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in EDGE}
    assert mixing.mixing(edge.limit(0)).count() == 0


def test_slots_and_words_like_brute_force(spark, docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()] + [(None, None, "one two three"), (7, "src1", "four five")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = mixing.targets(spark.createDataFrame([(s, size(t)) for _, s, t in rows], "source string, n long").groupBy("source").agg(F.sum("n").alias("source_size"))).collect()
    # documents of a source in order; rows of one doc_id in the order of their texts' hashes
    keyed = df.withColumn("h", F.xxhash64("text")).collect()
    own = {s["sid"]: sorted((r for r in keyed if r["source"] == s["source"]), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"])) for s in sources}
    frame = spark.createDataFrame([(s["source"], s["sid"], s["source_size"], s["target"]) for s in sources], "source string, sid int, source_size long, target double")
    got = mixing.slots(mixing.draws(frame)).collect()
    want = Counter()
    for s in sources:
        d = mixing.drawn(s["sid"], s["source_size"], s["target"])
        mine = sorted((r for r in got if r["sid"] == s["sid"]), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(d.slots))
        words = [k for k, r in enumerate(own[s["sid"]]) for _ in range(size(r["text"]))]
        taken = 0
        for r in mine:
            assert r["block"] == mixing.Permutation(d.blocks, s["sid"], r["slot"] // d.blocks)(np.array([r["slot"] % d.blocks]))[0]
            part = words[r["block"] * mixing.BLOCK : (r["block"] + 1) * mixing.BLOCK][: r["words"]]
            taken += len(part)
            for k in part:
                x = own[s["sid"]][k]
                want[x["doc_id"], x["source"], x["h"]] += 1
        assert taken == d.words
    shards = Counter(r["shard"] for r in got)
    assert all(n == mixing.SHARD_SLOTS for k, n in shards.items() if k < max(shards))
    sizes = {(r["doc_id"], r["source"], r["h"]): size(r["text"]) for r in keyed}
    told = Counter((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.mixing(df).collect())
    assert told == Counter((d or -1, sizes[d, s, h], want[d, s, h]) for d, s, h in sizes)


def test_many_sources_are_shared_out_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES_TOGETHER", 7)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    frame = spark.createDataFrame([(f"s{i}", i, 100 + 37 * i, 90.0 + 60 * i) for i in range(30)], "source string, sid int, source_size long, target double")
    got = mixing.slots(mixing.draws(frame)).collect()
    draws = [mixing.drawn(i, 100 + 37 * i, 90.0 + 60 * i) for i in range(30)]
    by = Counter(r["sid"] for r in got)
    assert all(by[d.sid] == d.slots for d in draws) and len({(r["sid"], r["slot"]) for r in got}) == len(got)
    shards = Counter(r["shard"] for r in got)
    assert all(n == 16 for k, n in shards.items() if k < max(shards))


# --- pipeline --------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, sf, docs, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    frames, now = [], docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(now)
        if k < len(cp.STAGES) - 1:
            assert set(now.columns) == set(docs.columns)
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frames[0]).collect()}
    assert ids[1] == set(classes.values())
    dirty = {r["doc_id"] for r in decontaminate.contamination(frames[1], read(spark, sf, "benchmark")).where("contaminated").collect()}
    assert ids[2] == ids[1] - dirty
    # the mix keeps the words that mixing() says it takes, and whole texts for whole epochs
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixing(frames[2]).collect() if r["taken"]}
    got, texts = Counter(), {r["doc_id"]: r["text"] for r in frames[2].collect()}
    for r in frames[3].collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert " ".join(words(r["text"])) in " ".join(words(texts[r["doc_id"]]))
    assert got == taken
    assert frames[4].count() == frames[3].count()
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, frames[4].collect()))


def test_pipeline_rows_without_an_id(spark, sf, docs):
    cp = pytest.importorskip("corpus_pipeline")
    item = read(spark, sf, "benchmark").where("length(text) > 100").first()["text"]
    texts = [f"text number {k} without an id has words of its own {k * 7} and {k * 11}" for k in range(3)]
    rows = [(None, t, "en", "a", len(t)) for t in [*texts, texts[0], item]] + [(5, texts[1] + " five", "en", "a", 9), (5, item, "en", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def left(stage, frame):
        return sorted((r["doc_id"] or 0, r["text"]) for r in stage(spark, frame, sf).collect())

    assert left(cp.keep_one_of_each, df.where("doc_id is null")) == sorted((0, t) for t in [*texts, item])
    assert left(cp.drop_contaminated, df) == sorted([(0, t) for t in [*texts, texts[0]]] + [(5, texts[1] + " five")])
    one = df.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    taken = sum(r["taken"] for r in mixing.mixing(one).collect())
    got = cp.mix_sources(spark, one, sf).collect()
    assert taken == sum(len(r["text"].split()) for r in got) > 0 and all(r["doc_id"] is None for r in got)
    assert all(any(r["text"].strip() in t for t in [*texts, item]) for r in got)


def test_pipeline_stages_on_the_edge_table(spark, sf, edge):
    cp = pytest.importorskip("corpus_pipeline")
    rows = edge.withColumn("n_chars", F.length("text").cast("long"))
    good = cp.keep_good(spark, rows, sf)
    assert good.columns == cp.COLUMNS and good.count() <= len(EDGE)
    one = sorted((r["doc_id"] or 0, r["text"] or "") for r in cp.keep_one_of_each(spark, rows, sf).collect())
    assert one == sorted((i or 0, t or "") for i, t, *_ in EDGE[1:])  # of the repeated row one
    assert cp.drop_contaminated(spark, rows, sf).count() == len(EDGE)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = cp.mix_sources(spark, rows, sf).collect()
    assert sum(size(r["text"]) for r in got) == sum(r["taken"] for r in mixing.mixing(rows).collect()) > 0
    assert all(r["n_chars"] == len(r["text"]) for r in got) and None in {r["doc_id"] for r in got}
    assert cp.write_tokens(spark, rows, sf).count() == len(EDGE)
    empty = rows.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_keeps_rows_apart_that_share_an_id(spark, sf):
    cp = pytest.importorskip("corpus_pipeline")
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (None, a + " x", "en", "s", 1), (None, "c d e f g h", "en", None, 1), (9, b, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in cp.keep_one_of_each(spark, df, sf).collect()) == sorted([(5, a), (5, b), (0, "c d e f g h")])
    taken = Counter()
    for r in cp.mix_sources(spark, df, sf).collect():
        taken[r["doc_id"]] += len(r["text"].split())
    assert sum(taken.values()) == sum(r["taken"] for r in mixing.mixing(df).collect())


# --- SQL -------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_minhash", "op7_embedding_dedup", "op8_decontamination"])
def test_queries_like_their_sql(spark, sf, name):
    import duckdb

    from slotwise.llm.queries import oracle_sql

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries()[name](spark, sf).toPandas(), con.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want)
