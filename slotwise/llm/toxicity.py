"""Toxic passages: maximal scoring segments over token log-odds.

Tokens are whole words, and single characters of scripts without spaces.
Log-odds of toxic against other labelled text get an informative Dirichlet
prior, which draws those of rare words to 0; the words that are significantly
toxic score their lower bound, all others a small loss.  A linear scan finds every maximal
scoring segment, and extreme-value statistics say what a score is worth in a
text of that length.  A logistic calibration of the summed worth is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import held_out, labelled_sample, parted, read, slices
from slotwise.llm.quality import logistic

_ALONE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f"
TOKEN = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
PRIOR = 50.0
#: How many deviations a word's log-odds must exceed zero by; which, the labelled sample decides.
LEAST_Z = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)
LEAST_ODDS = 2.0
LOSS = 1.0
#: Labelled rows of each class that the fit may see.
PER_CLASS = 5000
#: Expected number of such segments in clean text of that length, at most, for a passage to count.
LEAST_E = 0.05


def segments(places: list[int], scores: list[float], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order.

    places: of the tokens that score above zero, ascending; every other token
    costs `loss`.  Linear: each candidate is merged at most once.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to and with
    total, last = 0.0, 0
    for place, gain in zip(places, scores, strict=True):
        total -= loss * (place - last)
        start, before, total, last = place, total, total + gain, place + 1
        # join to the nearest earlier candidate that starts lower, if this one ends higher than it
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, last, before, total))
    return [(a, b, high - low) for a, b, low, high in found]


def tokens(text: str | None) -> list[str]:
    """Lower-cased words of a text; characters of scripts that set no spaces are words of their own."""
    return [w for part in parted(text or "") for w in TOKEN.findall(part.lower())]


def odds_of(ya: float, na: int, yb: float, nb: int) -> tuple[float, float]:
    """(log-odds, deviation) of a word in ya of na toxic and yb of nb other texts."""
    prior = PRIOR * (ya + yb) / (na + nb) + 0.01
    odds = math.log((ya + prior) / (na + 2 * PRIOR - ya)) - math.log((yb + prior) / (nb + 2 * PRIOR - yb))
    return odds, math.sqrt(1 / (ya + prior) + 1 / (yb + prior))


def in_contexts(texts: list[list[str]], words: set[str]) -> Counter[str]:
    """In how many texts each of the words is, but texts that have it between the same neighbours count once.

    A passage that many texts copied says of its words no more than one text does.
    """
    out: Counter[str] = Counter()
    seen: set[tuple[str, str, str]] = set()
    for t in texts:
        fresh = set()
        for i, w in enumerate(t):
            if w in words:
                at = (t[i - 1] if i else "", w, t[i + 1] if i + 1 < len(t) else "")
                if at not in seen:
                    seen.add(at)
                    fresh.add(w)
        out.update(fresh)
    return out


def log_odds(toxic: list[list[str]], clean: list[list[str]], least_z: float) -> dict[str, float]:
    """Lower bounds of the log-odds of significantly toxic words, counted once a text and context."""
    na, nb = len(toxic), len(clean)
    a, b = Counter(), Counter()
    for into, texts in ((a, toxic), (b, clean)):
        for t in texts:
            into.update(set(t))

    def significant(a, b, words):
        out = {}
        for w in words:
            odds, sd = odds_of(a[w], na, b[w], nb)
            if a[w] and odds >= LEAST_ODDS and odds >= least_z * sd:
                out[w] = odds - sd
        return out

    maybe = set(significant(a, b, a))
    return significant(in_contexts(toxic, maybe), b, sorted(maybe))


def decay(table: dict[str, float], clean: list[list[str]]) -> float:
    """The rate at which clean text's best segments become rarer: sum p exp(rate * score) = 1."""
    seen = Counter(w for t in clean for w in t if w in table)
    n = sum(map(len, clean)) + len(table)
    p = [((seen[w] + 0.5) / n, s) for w, s in table.items()]
    rest = 1 - sum(x for x, _ in p)
    at = lambda r: rest * math.exp(-LOSS * r) + sum(x * math.exp(min(700, r * s)) for x, s in p)
    low, high = 1e-6, 1e-6
    while at(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) < 1 else (low, mid)
    return low


def passages(words: list[str], table: dict[str, float], rate: float) -> list[tuple[int, int, float]]:
    """Significant segments: (first word, end word exclusive, worth in nats)."""
    places = [i for i, w in enumerate(words) if w in table]
    if not places:
        return []
    scores = [table[words[i]] for i in places]
    out = []
    for a, b, s in segments(places, scores):
        worth = rate * s - math.log(len(words))
        if worth >= -math.log(LEAST_E):
            out.append((a, b, worth))
    return out


def features(found: list[tuple[int, int, float]]) -> tuple[float, float]:
    return (1.0, math.log1p(sum(x[2] for x in found)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """(word scores, rate, weights); without labels of both classes a constant 0.5."""
    rows = labelled_sample(docs, labels, "toxic", per_class)
    one: dict[str, str] = {}  # equal words are one object: the sample stays small in memory
    texts = {y: [[one.setdefault(w, w) for w in tokens(t)] for t in dict.fromkeys(t for t, k in rows if k == y)] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return {}, 1.0, [0.0, 0.0]
    best = None
    for least_z in LEAST_Z:
        # each half is scored with what the other half teaches
        x, y = [], []
        for k in (0, 1):
            learn = {c: t[k::2] for c, t in texts.items()}
            table, rate = learned(learn, least_z)
            for c, t in texts.items():
                own = [features(passages(w, table, rate)) for w in t[1 - k :: 2]]
                x += own
                y += [float(c)] * len(own)
        x, y = np.array(x), np.array(y)
        weights = logistic(x, y, np.ones(len(y)))
        p = np.clip(1 / (1 + np.exp(-x @ weights)), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, least_z, weights)
    table, rate = learned(texts, best[1])
    return table, rate, best[2].tolist()


def learned(texts: dict[int, list[list[str]]], least_z: float) -> tuple[dict[str, float], float]:
    if not texts[0] or not texts[1]:
        return {}, 1.0
    table = log_odds(texts[1], texts[0], least_z)
    return table, decay(table, texts[0]) if table else 1.0


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, passages): the passages as word ranges with their worth in nats.

    A null or empty text has none and scores as any clean text; repeated rows
    are scored each; of segments that tie, the first found stands; an empty
    table gives no rows; other columns are not read.
    """
    table, rate, weights = model

    def run(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("worth", pa.float64())]))
        for b, texts in slices(batches):
            found = [passages(tokens(t), table, rate) for t in texts]
            x = np.array([features(f) for f in found]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array([[{"first": i, "end": j, "worth": v} for i, j, v in f] for f in found], kind)],
                ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,end:int,worth:double>>")


def op9_toxicity(spark, sf_dir, threshold: float = 0.5):
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
