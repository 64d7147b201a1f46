"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from good labelled text, one from bad.  A text is
compressed with each, in pieces that the dictionary still matters for; the
difference of the sizes, once over their sum and once over the text's own
size, goes through a logistic calibration to the probability of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import give_back, held_out, labelled_sample, read, slices

PIECE = 2048
DICTIONARY = 32768
#: Labelled rows of each class that the fit may see; half build the dictionaries, half calibrate.
PER_CLASS = 5000


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; x has its own column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        def of(raw):
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_AUTO) if raw else None
            return zs.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = of(good), of(bad)

    def features(self, text: str | None) -> tuple[float, float, float]:
        b = (text or "").encode("utf-8", "surrogatepass")
        g = q = 0
        for i in range(0, len(b), PIECE):
            piece = b[i : i + PIECE]
            g += len(self.good.compress(piece))
            q += len(self.bad.compress(piece))
        return (1.0, 10 * (g - q) / max(1, g + q), 10 * (g - q) / max(1, len(b)))


def dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A dictionary from the distinct lines of the texts, so that boilerplate doesn't fill it."""
    import zstandard as zs

    lines = list(dict.fromkeys(line for t in texts for line in t.split("\n") if len(line) > 8))
    raw = "\n".join(lines).encode("utf-8", "surrogatepass")
    pieces = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
    try:
        return zs.train_dictionary(size, pieces).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself is the dictionary
        return raw[:size]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[bytes, bytes, list[float]]:
    """(good dictionary, bad dictionary, weights); without labels a constant 0.5."""
    rows = labelled_sample(docs, labels, "quality", per_class)
    share = {r["quality"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    build, check = rows[::2], rows[1::2]
    if len({y for _, y in build}) < 2 or len({y for _, y in check}) < 2:
        return b"", b"", [0.0, 0.0, 0.0]
    good, bad = (dictionary([t for t, y in build if y == k]) for k in (1, 0))
    c = Compressors(good, bad)
    x = np.array([c.features(t) for t, _ in check])
    y = np.array([y for _, y in check], float)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    # each class weighs as in all labels, not as in the balanced sample
    weight = np.where(y == 1, share.get(1, 1) / n[1], share.get(0, 1) / n[0])
    weights = logistic(x, y, weight / weight.mean()).tolist()
    del rows, build, check
    give_back()
    return good, bad, weights


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]], column: str = "score") -> DataFrame:
    """docs with the probability of label 1 in a new column; a null text counts as empty.

    Columns of docs keep their names and order; one named like the new column
    is replaced.  Repeated rows are scored each, equal texts the same; texts
    of any length are compressed whole, piece by piece; an empty table gives
    no rows.
    """
    from pyspark.sql import types as T

    good, bad, weights = model
    kept = [f for f in docs.schema if f.name != column]

    def run(batches):
        c, w = Compressors(good, bad), np.array(weights)
        for b, texts in slices(batches, "text"):
            x = np.array([c.features(t) for t in texts]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, column])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(column, T.DoubleType())]))


def op4_quality_classifier(spark, sf_dir, threshold: float = 0.3):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
