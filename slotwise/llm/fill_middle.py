"""Fill-in-middle: a text is cut at two of its word boundaries, and its middle moved to the end.

A text is decoded to an array of code points.  Where the class of a code point,
blank or not, differs from its neighbour's, one comparison of the array with
itself shows it; the flat indices of the steps from other to blank are the
places where units end.  Two of them, chosen by rank from a hash of the id, cut
the array into prefix, middle and suffix, which are encoded again in the order
that the form asks for.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import free_name, read, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = re.compile("<[PSM]>")
SEED = "42"
#: Of a hundred texts, how many change their form; of a hundred of those, how many have the suffix first.
CHANGED, SUFFIX_FIRST = 50, 80
_CODES = "utf-32-le"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, places where units end, from 0 on): a unit is a run of other characters with the blanks before it, or the blanks at the end."""
    codes = np.frombuffer(text.encode(_CODES, "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return codes, np.r_[0, ends, len(codes)] if len(codes) else np.zeros(1, np.int64)


def draws(doc_id, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits; a row without an id has those of an empty id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def moved(text: str | None, doc_id, seed: str = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, str, int | None, int | None]:
    """(output, units, form, characters of the prefix, of the middle) of one text."""
    text = text or ""
    codes, at = boundaries(text)
    n = len(at) - 1
    a, b, c, d = draws(doc_id, seed)
    if not text or c % 100 >= changed or _MARK.search(text):
        return text, n, "plain", None, None
    low, high = (int(x) for x in at[sorted((a % (n + 1), b % (n + 1)))])
    prefix, middle, suffix = (x.tobytes().decode(_CODES, "surrogatepass") for x in (codes[:low], codes[low:high], codes[high:]))
    if d % 100 < suffix_first:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", n, "spm", low, high - low
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", n, "psm", low, high - low


def put_back(output: str | None, form: str) -> str | None:
    """The text that an output was made from.  No part holds a mark and no mark overlaps itself, so the first of each kind is the one put in."""
    if form == "plain" or output is None:
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, seed: str = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs, row by row, with their texts in their new form and four more columns: n (units), form (plain, psm, spm), prefix_chars and middle_chars.

    A null text counts as empty and comes out empty; an empty text, and one that
    holds a mark, stays plain, with null for both counts.  Which cut and form a
    text has is up to its doc_id and the seed alone, so repeated rows come out
    equal; rows without an id share one draw.  Texts of blanks only are one
    unit.  Columns of docs that have one of the new names are replaced; others
    stay as they are.  An empty table gives no rows.
    """
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]

    def run(batches):
        for b, texts in slices(batches, "text"):
            out = [moved(t, i, seed, changed, suffix_first) for t, i in zip(texts, b.column("doc_id").to_pylist(), strict=True)]
            text, *more = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [], [])
            own = [pa.array(text, pa.string()) if name == "text" else b.column(name) for name in b.schema.names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, k) for x, k in zip(more, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True))], [*b.schema.names, *(f.name for f in new)])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, *new]))


def restored(moved_docs: DataFrame) -> DataFrame:
    """fill_in_middle's rows with a new last column, restored: the texts as they were, null ones empty."""
    name = free_name(moved_docs, "restored")

    def run(batches):
        for b, texts in slices(batches, "text"):
            back = [put_back(t, f) for t, f in zip(texts, b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*b.schema.names, name])

    return moved_docs.mapInArrow(run, T.StructType([*moved_docs.schema.fields, T.StructField(name, T.StringType())]))


def op12_fill_in_middle(spark, sf_dir):
    """What every document became, and a digest of it and of the text put back from it."""
    out = restored(fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(name) for c, name in (("text", "output_sha256"), ("restored", "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
