"""Profiles from what a model reads in conversations, product texts and behaviour: structured answers, merged field by field.

A model's answer is JSON, however it is wrapped. A field that it gives replaces the profile's; one that it leaves out, or an answer that doesn't
parse, changes nothing. Every field that is set carries where it came from: the text's id and time, and of several answers for one
profile the last one that gives a field counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as fn

#: What a model is asked for, and the profile's group and field that each goes to.
USER_FIELDS = {
    "age_range": ("basic", "string"), "gender": ("basic", "string"), "region": ("basic", "string"), "price_sensitivity": ("consumption", "string"),
    "preferred_categories": ("interests", "array<string>"), "preferred_brands": ("interests", "array<string>"), "preferred_styles": ("interests", "array<string>"), "tags": ("tags", "array<string>"), "shopping_habits": ("insights", "array<string>"),
}
PRODUCT_FIELDS = {
    "name": ("basic", "string"), "category": ("basic", "string"), "brand": ("basic", "string"), "style_tags": ("tags", "array<string>"), "scene_tags": ("tags", "array<string>"), "crowd_tags": ("tags", "array<string>"), "season_tags": ("tags", "array<string>"),
    "keywords": ("keywords", "array<string>"), "selling_points": ("keywords", "array<string>"),
}
Chat = Callable[[str], str]


def answered(df: DataFrame, text: str, make: Callable[[], Chat], to: str = "answer") -> DataFrame:
    """df with a model's answer to each text; a failure is null. The model is made once a task."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def one(t: str | None) -> str | None:
            try:
                return model(t) if t else None
            except Exception:
                return None

        for s in batches:
            yield s.map(one)

    return df.withColumn(to, run(F.col(text)))


def _set(c: Column, kind: str) -> Column:
    return F.when(F.size(c) > 0, c) if kind.startswith("array") else F.when(c != "", c)


def updates(answers: DataFrame, key: str, fields: dict[str, tuple[str, str]], order: Column, source: Column) -> DataFrame:
    """(key, grp, field, value, source): for each profile and field the last answer's value, an array, with its source. Answers are (key, answer)."""
    parsed = fn.lenient_json(F.col("answer"), ", ".join(f"{f} {kind}" for f, (_, kind) in fields.items()))
    a = answers.select(key, parsed.alias("p"), order.alias("_o"), source.alias("source"))
    cells = []
    for f, (group, kind) in fields.items():
        v = _set(F.col(f"p.{f}"), kind)
        cells.append(F.struct(F.lit(group).alias("grp"), F.lit(f).alias("field"), (v if kind.startswith("array") else F.when(v.isNotNull(), F.array(v))).alias("value")))
    each = a.select(key, "_o", "source", F.explode(F.array(*cells)).alias("c")).where("c.value IS NOT NULL")
    last = each.groupBy(key, F.col("c.grp").alias("grp"), F.col("c.field").alias("field")).agg(F.max_by(F.struct("c.value", "source"), F.struct("_o", "source")).alias("r"))
    return last.select(key, "grp", "field", "r.value", "r.source")


def built(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Profile cells (key, grp, field, value, source) with those of new in their place; a habit or insight is added, not replaced."""
    both = held.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    one = both.where("grp <> 'insights'").groupBy(key, "grp", "field").agg(F.max_by(F.struct("value", "source"), "_n").alias("r")).select(key, "grp", "field", "r.value", "r.source")
    more = both.where("grp = 'insights'").groupBy(key, "grp", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("value")))).alias("value"), F.max_by("source", "_n").alias("source"))
    return one.unionByName(more)


def behaviour_answers(edges: DataFrame, user: str = "user_id", most: int = 20) -> DataFrame:
    """(user, answer): a stand-in for the model that reads behaviour: how many of a user's last `most` edges have each relation, as insights."""
    from memloom.operators.skew import top_per

    last = top_per(edges, [user], most, [F.desc("ts"), F.desc("event_id")], "event_id")
    n = last.groupBy(user, "relation").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.concat_ws(": ", "relation", F.col("n").cast("string"))))  # a few relations
    return n.groupBy(user).agg(F.to_json(F.struct(lines.alias("shopping_habits"))).alias("answer"))
