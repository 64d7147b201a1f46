"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]+"
# Fixed value: white space that is trimmed from records.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def clipped(text: Column, n: int, mark: str = "") -> Column:
    """The first n characters; where that leaves something out, the mark follows."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def slot(subject: Column, predicate: Column) -> Column:
    """The grouping key of a claim."""
    return F.concat(F.lower(F.trim(subject)), F.lit("::"), F.lower(F.trim(predicate)))


def digest(slot_key: Column, value: Column, body: Column) -> Column:
    """Sixteen hex digits of what a card says."""
    basis = F.concat_ws("|", slot_key, F.lower(F.trim(F.coalesce(value, F.lit("")))), F.trim(F.coalesce(body, F.lit(""))))
    return F.substring(F.sha1(basis.cast("binary")), 1, 16)


def _units(text: Column) -> Column:
    """The UTF-16 code units of a text; a character beyond the first plane is two."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    high = lambda c: F.lit(0xD800) + F.floor((c - 0x10000) / 1024).cast("int")
    return F.flatten(F.transform(codes, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(F.array(high(c), F.lit(0xDC00) + (c - 0x10000) % 1024))))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units' codes, as eight hex digits."""
    h = F.aggregate(_units(text), F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def comparable(text: Column) -> Column:
    """Lower-cased, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\p{P}\p{S}]", "")


def bigrams(text: Column) -> Column:
    """Distinct character pairs; a single character stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) == 1, F.array(text)).otherwise(F.array_distinct(pairs))


# Fixed values in similarity_of: weights of dice and coverage, and of the lengths' ratio.
def similarity_of(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Similarity of comparable texts with their bigrams at hand."""
    both = F.size(F.array_intersect(grams_a, grams_b)).cast("double")
    na, nb = F.size(grams_a), F.size(grams_b)
    dice = (2 * both) / (na + nb)
    coverage = both / F.least(na, nb)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    score = F.least(F.lit(1.0), (0.35 * dice + 0.65 * coverage) * (0.85 + 0.15 * ratio))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(score)


def similarity(a: Column, b: Column) -> Column:
    """Dice and coverage of the shorter text's bigrams, damped by the lengths' ratio; 0 to 1."""
    x, y = comparable(a), comparable(b)
    return similarity_of(x, y, bigrams(x), bigrams(y))


def tokens(text: Column) -> Column:
    """Search tokens: pairs of neighbouring CJK characters and lower-cased ASCII words."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_union(pairs, words)


def slug(text: Column, limit: int = 40) -> Column:
    """ASCII slug; text without ASCII letters and digits gets a short hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(plain == "", F.substring(F.sha1(text.cast("binary")), 1, 8)).otherwise(plain), 1, limit)


def short_slug(text: Column, limit: int = 40) -> Column:
    """The other slug of file names: text without ASCII letters and digits gets a hash of its own in base 36."""
    low = F.lower(trimmed(text))
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(plain, 1, limit), "-+$", "")
    h = F.aggregate(_units(low), F.lit(0).cast("long"), lambda a, c: (a * 31 + c.cast("long")).bitwiseAND(F.lit(4294967295)))
    return F.when(plain != "", cut).otherwise(F.substring(F.lower(F.conv(h.cast("string"), 10, 36)), 1, 8))


def quoted(text: Column) -> Column:
    """A front-matter scalar, quoted where it would read as something else."""
    plain = F.coalesce(text, F.lit(""))
    risky = plain.rlike(r'^\s|\s$|^[\[\]{}&*!|>%@`"\x27#?,-]|: |:$| #') | plain.rlike(r"(?i)^(true|false|yes|no|on|off|null|none|~|-?\d+(\.\d+)?)$")
    return F.when(plain == "", F.lit('""')).when(risky, F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))).otherwise(plain)
