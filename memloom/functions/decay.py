"""Time decay as column expressions; the reference time is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(ts: Column, ref: Column) -> Column:
    """Days, with fractions, from ts to ref."""
    return (F.unix_micros(ref.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6


def boost(days: Column) -> Column:
    """1.2 on the first day, then .9 a week."""
    return F.when(days < 1, 1.2).otherwise(F.pow(F.lit(0.9), days / 7))


def weight(ts: Column, importance: Column, ref: Column) -> Column:
    """importance * boost, at most 1; the importance alone where there is no time."""
    days = F.greatest(days_between(ts, ref), F.lit(0.0))
    return F.when(ts.isNull(), importance).otherwise(F.least(importance * boost(days), F.lit(1.0)))


def recall_time(ts: Column, ref: Column) -> Column:
    """exp(-days / 7), whole days, at least .1; .5 without a time."""
    return F.when(ts.isNull(), 0.5).otherwise(F.greatest(F.exp(-F.floor(days_between(ts, ref)) / 7), F.lit(0.1)))


def rerank_time(ts: Column, ref: Column, factor: float = 0.1) -> Column:
    """exp(-factor * days / 30), whole days, within [0, 1]; .5 without a time."""
    return F.when(ts.isNull(), 0.5).otherwise(F.greatest(F.least(F.exp(-factor * F.floor(days_between(ts, ref)) / 30), F.lit(1.0)), F.lit(0.0)))


def confidence(value: Column, days: Column) -> Column:
    """.95 a month, at least .1."""
    return F.greatest(value * F.pow(F.lit(0.95), days / 30), F.lit(0.1))


def parsed(text: Column) -> Column:
    """A timestamp from the text forms in use; null where none fits. Times without a zone are UTC (the session's)."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(f)) for f in forms))
