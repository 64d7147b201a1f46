"""Secrets in text: fixed patterns, and values that would be costly to guess.

Values in a credential context ("pwd: ...") get a guess cost: the cheapest
segmentation into common words, dates, repeats, keyboard walks and brute-force
spans, by dynamic programming.  Words are ranked by the number of documents of
the corpus that have them, behind a short list of common passwords.  A value that costs enough is a secret even
where no fixed pattern knows it, or knows a part of it only.
"""

from __future__ import annotations

import hashlib
import math
import re

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Workspace, parted, read, slices

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Keys whose value is a credential, beyond those of ASSIGN.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:phrase|code|word|wd)?|pwd|passkey|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth|bearer)["']?[\x20\t]{0,4}(?::|=>?)[\x20\t]{0,4}["']?([^\s"'`,;<>|]{6,})""",
    re.ASCII | re.IGNORECASE)
#: Guesses, as a power of 2, from which a value counts as a secret.
LEAST_BITS = 30.0
LONGEST_PART = 40
#: The corpus' own words that the guess cost knows: so many, of so many letters.
MOST_WORDS = 20_000
SHORTEST_WORD, LONGEST_WORD = 4, 24
WORDS = re.compile(rf"(?<![^\W_])[^\W\d_]{{{SHORTEST_WORD},{LONGEST_WORD}}}(?![^\W_])")
#: Different words that a task counts before it hands them on.
HELD_WORDS = 500_000

# Common parts of passwords, by rank.
COMMON = (
    "password 123456 qwerty admin welcome letmein monkey dragon login master hello freedom whatever shadow sunshine princess "
    "football baseball superman michael charlie jordan trustno1 secret test guest changeme default root user pass love summer "
    "winter spring autumn hunter ranger soccer hockey killer george andrew jessica thomas robert daniel computer internet example sample token key api "
    "abc iloveyou starwars access flower batman cheese coffee orange banana cookie family friend lucky magic money music ninja "
    "office peanut pepper purple silver golden tiger turtle yellow system server service database local public private temp dummy none null true false value string"
).split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON))}
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!5$7+", "aaeoiisstt")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            own = near.setdefault(c, set())
            for other, shift in ((row, (-1, 1)), (ROWS[r - 1] if r else "", (0, 1)), (ROWS[r + 1] if r + 1 < len(ROWS) else "", (-1, 0))):
                own.update(other[i + d] for d in shift if 0 <= i + d < len(other))
    return near


NEAR = _neighbours()


def brute_bits(s: str) -> float:
    """Bits of trying all strings over the character classes that occur."""
    size = 26 * any(c.islower() for c in s) + 26 * any(c.isupper() for c in s) + 10 * any(c.isdigit() for c in s) + 33 * any(not c.isalnum() for c in s)
    return len(s) * math.log2(max(size, 10))


def word_ranks(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """Ranks of common words: the fixed list, then the corpus' own by the documents that have them, ties by code point.

    All texts are counted, but for values in a credential context; what reaches
    the driver is bounded by `most`.
    """

    def run(batches):
        seen: Counter[str] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for _, texts in slices(batches, 0):
            for t in texts:
                own: set[str] = set()
                for part in parted(t or ""):
                    # a credential's value doesn't become a common word by standing there
                    plain = CONTEXT.sub(" ", part) if ":" in part or "=" in part else part
                    own.update(WORDS.findall(plain.lower()))
                seen.update(own)
            if len(seen) > HELD_WORDS:
                yield rows()
        if seen:
            yield rows()

    ws = Workspace(docs.sparkSession, "words")
    counts = ws.put(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    # classes of counts, a sixteenth of a doubling each, tell from where on the words are enough
    size = F.floor(16 * F.log2("n")).cast("int")
    least, held = 0, 0
    for r in sorted(counts.groupBy(size.alias("c")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["c"]):
        least, held = r["c"], held + r["n"]
        if held >= most:
            break
    found = [r["word"] for r in counts.where(size >= least).orderBy(F.desc("n"), "word").limit(most).collect()]
    ws.close()
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *found]))}


def guess_bits(value: str, ranks: dict[str, int] = RANK, limit: float = math.inf) -> float:
    """log2 of the guesses that the cheapest segmentation needs; 0 for an empty value.

    Costs only grow, so from where all open segmentations are at the limit a
    number not under it is returned at once.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a letter whose lower case is two
        low = value
    plain = low.translate(LEET)
    per_char = brute_bits(value) / n if n else 0.0
    best = [0.0] + [math.inf] * n
    # a run of brute-forced characters pays for its start once
    brute = [math.inf] * (n + 1)
    start_cost, far = 1.0, 0
    for i in range(n):
        brute[i + 1] = min(brute[i], best[i] + start_cost) + per_char
        best[i + 1] = min(best[i + 1], brute[i + 1])
        here = best[i] + start_cost
        top = min(n, i + LONGEST_PART)
        for j in range(i + 3, min(top, i + LONGEST_WORD) + 1):  # words, with case and letter substitutions
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                part = value[i:j]
                extra = (part != low[i:j]) * (1.0 if part[1:] == low[i + 1 : j] else j - i) + (low[i:j] != plain[i:j] and low[i:j] not in ranks) * 2.0
                best[j] = min(best[j], here + math.log2(rank + 1) + extra)
                far = max(far, j)
        m = DATE.match(value, i)
        if m:
            best[m.end()] = min(best[m.end()], here + math.log2(365 * 120) + 2)
            far = max(far, m.end())
        j = i + 1
        while j < top and value[j] == value[i]:
            j += 1
            if j - i >= 3:
                best[j] = min(best[j], here + per_char + math.log2(j - i))
                far = max(far, j)
        for width in range(2, 9):  # repeats of longer parts
            j = i + width
            while j + width <= n and value[j : j + width] == value[i : i + width] and j < i + 8 * LONGEST_PART:
                j += width
                best[j] = min(best[j], here + width * per_char + math.log2((j - i) // width))
                far = max(far, j)
        j, turns, way = i + 1, 0, 0
        while j < top:  # keyboard walks and runs of the alphabet or digits
            a, b = low[j - 1], low[j]
            step = ord(b) - ord(a)
            if b in NEAR.get(a, ()) or (step in (-1, 1) and a.isalnum() and b.isalnum()):
                turns, way = turns + (step != way), step
                j += 1
                if j - i >= 3:
                    best[j] = min(best[j], here + math.log2(47) + turns * 2 + math.log2(j - i))
                    far = max(far, j)
            else:
                break
        if best[i + 1] >= limit and min(best[i + 1 : max(far, i + 1) + 1]) >= limit:
            return best[i + 1]
    return best[n]


def spans_of(text: str | None, least_bits: float = LEAST_BITS, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind's number, end) in order; code points, end exclusive."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more = []
    if ":" in text or "=" in text:
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            met = [(s, e) for s, _, e in base if s < b and a < e]
            # beside base spans only what is not just a closing bracket after them
            end = a + len(m[1].rstrip(")]}")) if met else b
            if not any(s <= a and end <= e for s, e in met) and guess_bits(m[1], ranks, least_bits) >= least_bits:
                more.append((a, 3, b))
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    A null or empty text has no spans; values of any length are looked at
    whole; repeated rows stay rows of their own; an empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    ranks = word_ranks(docs)

    def run(batches):
        for b, texts in slices(batches):
            found = [spans_of(t, least_bits, ranks) for t in texts]
            counts = [pa.array([sum(x[1] == k for x in own) for _, own in found], pa.int64()) for k in range(4)]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(own) for _, own in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def op5_secret_scan(spark, sf_dir):
    return secret_scan(read(spark, sf_dir, "documents"))
