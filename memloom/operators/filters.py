"""Filter trees, named time ranges, and guards, as predicates that Catalyst pushes to the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree(node: dict, schema_arrays: frozenset[str] = frozenset()) -> Column | None:
    """A predicate from {operator, path, value*} / {operator: And|Or, operands}.

    Equal on a path of two parts, or on an array, asks for membership. Falsy constants are constants. Unknown operators give None and an
    operand that gives None is left out.
    """
    op = node.get("operator")
    if op in ("And", "Or"):
        parts = [p for p in (tree(x, schema_arrays) for x in node.get("operands", [])) if p is not None]
        out = None
        for p in parts:
            out = p if out is None else (out & p if op == "And" else out | p)
        return out
    path = node.get("path", [])
    value = next((node[k] for k in ("valueString", "valueNumber", "valueBoolean", "valueInt", "valueStringArray") if node.get(k) is not None), None)
    if not path or value is None:
        return None
    c = F.col(path[0])
    for part in path[1:]:
        c = c.getField(part)
    if op == "Equal":
        return F.array_contains(c, value) if len(path) == 2 or path[-1] in schema_arrays else c == F.lit(value)
    if op == "ContainsAny":
        return F.arrays_overlap(c, F.array(*(F.lit(v) for v in (value if isinstance(value, list) else [value]))))
    return None


def filtered(df: DataFrame, node: dict, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows that a filter tree keeps, in key order where limited."""
    arrays = frozenset(f.name for f in df.schema if f.dataType.typeName() == "array")
    p = tree(node, arrays)
    df = df if p is None else df.where(p)
    return df if limit is None else df.orderBy(key).limit(limit)


def named_range(name: str | None, now: dt.datetime, start: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Inclusive bounds of a named range; an explicit start or end overrides, seven days by default."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    week = dt.timedelta(days=7)
    known = {"today": (day, now), "yesterday": (day - dt.timedelta(days=1), day), "week": (now - week, now), "lastweek": (now - 2 * week, now - week), "month": (now - dt.timedelta(days=30), now)}
    lo, hi = known.get(name or "", (now - week, now))
    if start is not None:
        lo = dt.datetime.combine(start, dt.time.min, tzinfo=now.tzinfo)
    if end is not None:
        hi = dt.datetime.combine(end, dt.time.max, tzinfo=now.tzinfo)
    return lo, hi


def within(df: DataFrame, lo: dt.datetime, hi: dt.datetime, column: str = "ts") -> DataFrame:
    """Both bounds included; constants, so the scan can skip row groups."""
    form = lambda x: F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    return df.where(F.col(column).between(form(lo), form(hi)))


#: What a question's words say of its time, first match wins: days back from now, from and to.
HINTS = {"上周": (14, 7), "last week": (14, 7), "昨天": (2, 1), "yesterday": (2, 1), "今天": (1, 0), "today": (1, 0), "本周": (7, 0), "this week": (7, 0), "本月": (30, 0), "this month": (30, 0)}


def hinted_range(question: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime] | None:
    for word, (a, b) in HINTS.items():
        if word in question.lower():
            return now - dt.timedelta(days=a), now - dt.timedelta(days=b)
    return None
