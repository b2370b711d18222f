"""Compression of memories to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TECH = r"(?i)\b(Python|Go|Java|React|Vue|Docker|Redis|PostgreSQL|MongoDB|Kubernetes|OpenAI|LLM|GPT|Claude)\b"
#: Verbs between the two halves of a core fact, in the order they are tried.
VERBS = ("是|在|用|做|开发|负责|参与", "说|告诉|问|讨论")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def core_fact(text: Column | str, ends: str = "[。！？]") -> Column:
    """Subject, verb and object of the first clause that has them, else the first sentence, 50 characters of it."""
    t = _c(text)
    out = None
    for verbs in VERBS:
        found = F.nullif(F.regexp_extract(t, rf"([^\s，。！？]+)({verbs})([^\s，。！？]+)", 0), F.lit(""))
        out = found if out is None else F.coalesce(out, found)
    return F.coalesce(out, F.substring(F.split(t, ends)[0], 1, 50))


def facts(text: Column | str, most: int, ends: str = r"[。！？\n]", spo: bool = True) -> Column:
    """The first distinct facts, a sentence each."""
    sentences = F.filter(F.transform(F.split(_c(text), ends), lambda s: F.trim(s)), lambda s: s != "")
    each = F.transform(sentences, lambda s: core_fact(s) if spo else F.substring(s, 1, 50))
    return F.array_join(F.slice(F.array_distinct(each), 1, most), " | ")


def truncate(text: Column | str, most: int | Column) -> Column:
    """Cut; at the last full stop if it lies in the last three tenths, else with an ellipsis."""
    t, m = _c(text), F.lit(most) if isinstance(most, int) else most
    cut = F.substr(t, F.lit(1), m)
    back = F.locate("。", F.reverse(cut))
    last = F.length(cut) - back  # from 0
    return F.when(F.length(t) <= m, t).when((back > 0) & (last > m * 0.7), F.substr(cut, F.lit(1), last + 1)).otherwise(F.concat(cut, F.lit("...")))


def compress(text: Column | str, ratio: float) -> Column:
    t = _c(text)
    if ratio >= 1:
        return t
    if ratio <= 0.2:
        return core_fact(t)
    if ratio <= 0.6:
        return facts(t, 3 if ratio <= 0.4 else 5)
    return truncate(t, F.floor(F.length(t) * ratio).cast("int"))


def tags(text: Column | str, most: int = 5) -> Column:
    """Technologies and the first Chinese words, sorted, joined."""
    t = _c(text)
    words = F.slice(F.regexp_extract_all(t, F.lit(r"([\x{4e00}-\x{9fa5}]{2,4})"), F.lit(1)), 1, 5)
    both = F.array_union(F.regexp_extract_all(t, F.lit(TECH), F.lit(1)), words)
    return F.array_join(F.slice(F.array_sort(both), 1, most), " | ")


def budget(page: DataFrame, most: int, order: Column, first: Column, second: Column, *group: str) -> DataFrame:
    """The fold over ranked rows of a page: take `first` if it fits what is left of `most`, else `second`, else stop.

    A page is a recall's list, bounded by its limit; with `group` there is one fold for each.
    """
    row = F.struct(order.alias("o"), F.col("id").alias("id"), first.alias("a"), second.alias("b"))
    held = page.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(True).alias("going"), F.expr("CAST(array() AS array<struct<id:bigint,text:string,total:bigint>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        total = s["total"]
        pick = F.when(total + F.length(x["a"]) <= most, x["a"]).when(total + F.length(x["b"]) <= most, x["b"])
        more = (total + F.length(pick)).cast("long")
        taken = F.struct(more.alias("total"), F.lit(True).alias("going"), F.concat(s["out"], F.array(F.struct(x["id"].cast("long").alias("id"), pick.alias("text"), more.alias("total")))).alias("out"))
        stop = F.struct(total.alias("total"), F.lit(False).alias("going"), s["out"].alias("out"))
        return F.when(s["going"] & pick.isNotNull(), taken).otherwise(stop)

    return held.select(*group, F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r")).select(*group, "r.*")
