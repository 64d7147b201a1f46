"""Dates, ages and decay; the reference time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of dates.
FORMATS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d H:m:s", "yyyy-M-d")


def parsed(text: Column) -> Column:
    """Timestamp of the four accepted forms, any Z ignored; else null."""
    plain = F.replace(F.trim(text), F.lit("Z"), F.lit(""))
    # a text's colons and T say which form it can have; the others, each a raised error, are not tried
    marks, at = F.length(plain) - F.length(F.replace(plain, F.lit(":"), F.lit(""))), F.contains(plain, F.lit("T"))
    in_form = [F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS]
    return F.when((marks == 2) & at, in_form[0]).when(marks == 1, in_form[1]).when(marks == 2, in_form[2]).when(marks == 0, in_form[3])


def normalized_date(text: Column, today: Column) -> Column:
    """today, now, yesterday and dates as ISO dates; anything else unchanged."""
    word = F.lower(F.trim(text))
    iso = F.date_format(parsed(text), "yyyy-MM-dd")
    return F.when(word.isin("today", "now"), F.date_format(today, "yyyy-MM-dd")).when(word == "yesterday", F.date_format(F.date_sub(today, 1), "yyyy-MM-dd")).otherwise(F.coalesce(iso, text))


def age_days(recorded: Column, valid_from: Column, ref: Column) -> Column:
    """Days since recording, else since validity began, else 0; not below 0."""
    since = F.coalesce(recorded.cast("timestamp"), valid_from.cast("timestamp"))
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_timestamp(ref) - F.unix_timestamp(since)) / 86400.0, F.lit(0.0)))


def days_since_hit(last_hit: Column, recorded: Column, valid_from: Column, ref: Column) -> Column:
    """Days since the last use; without one the age."""
    since = F.greatest(F.lit(0.0), (F.unix_timestamp(ref) - F.unix_timestamp(last_hit.cast("timestamp"))) / 86400.0)
    return F.when(last_hit.isNotNull(), since).otherwise(age_days(recorded, valid_from, ref))


def recency(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def reuse(hits: Column) -> Column:
    return F.least(F.lit(1.0), F.log(1.0 + hits) / F.log(F.lit(21.0)))


def effective_ttl(ttl: Column, importance: Column) -> Column:
    return F.floor(ttl * (0.7 + 0.6 * importance))


def valid_at(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Half-open validity; open ends hold always."""
    return F.coalesce(valid_from <= day, F.lit(True)) & F.coalesce(valid_to > day, F.lit(True))
