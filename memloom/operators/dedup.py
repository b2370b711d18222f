"""Duplicates, retention and row-level changes, as whole-table rewrites."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators import metric_join, skew, vector
from memloom.operators.shared import stored
from memloom.operators.vector_index import matrix


def exact_duplicates(df: DataFrame, text: str = "content", key: str = "id") -> DataFrame:
    """(key, kept) of each row that repeats a text: the smallest key of the text is kept.

    The smallest key is an aggregate with a partial step, joined back by the text's hash: no group of copies is gathered.
    """
    h = df.select(key, F.xxhash64(text).alias("h"), F.md5(F.coalesce(text, F.lit(""))).alias("m"))
    first = h.groupBy("h", "m").agg(F.min(key).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return h.join(first, ["h", "m"]).where(F.col(key) > F.col("kept")).select(key, "kept")


def similar_pairs(df: DataFrame, least: float, key: str = "id", column: str = "embedding") -> DataFrame:
    """(a, b, similarity) of all pairs a < b with cosine similarity of `least` or more, by metric_join.

    Vectors without a length match nothing.
    """
    return metric_join.similar_pairs(df, least, key, column)[0]


def keep_first(pairs: DataFrame) -> DataFrame:
    """(drop, kept): each row that a smaller similar one precedes, with the smallest such."""
    return pairs.groupBy(F.col("b").alias("dropped")).agg(F.min("a").alias("kept"))


def _cut(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder, so that plans of rounds stay short."""
    return stored(df, "dedup")


#: Lengths of beginnings by which short heads are looked up, held rows of a head that are tried first, and new rows of a head that meet pair by pair.
STARTS, FIRST, LEAD = (1, 2, 4, 8, 16), 8, 64


def holding(heads: DataFrame, head: int = 100) -> DataFrame:
    """(small, large): the pairs of different texts of `heads` (distinct, `head` characters at most) of which one holds the other, at any place.

    Texts of full length are held by none. Of the others' beginnings it is known which lengths of text they begin; where a text holds a
    beginning, its substrings of these lengths are looked up. Nothing is compared pair by pair.
    """
    short = heads.where(F.char_length("head") < head).select(F.col("head").alias("small"), F.char_length("head").alias("n"))
    q = F.array_max(F.filter(F.array(*map(F.lit, STARTS)), lambda x: x <= F.col("n")))
    short = _cut(short.withColumn("q", q).withColumn("start", F.substring("small", F.lit(1), F.col("q"))))
    starts = _cut(short.groupBy("q", "start").agg(F.collect_set("n").alias("ns")))  # fewer lengths than `head`
    used = [r.q for r in starts.select("q").distinct().collect()]
    if not used:
        return heads.select(F.col("head").alias("small"), F.col("head").alias("large")).where("false")
    listed = F.broadcast(starts) if starts.count() <= skew.BROADCAST else starts
    pieces = lambda n: F.expr(f"transform(sequence(1, char_length(head) - {n} + 1), i -> substring(head, i, {n}))")
    at = [heads.where(F.char_length("head") > n).select("head", F.lit(n).alias("q"), F.posexplode(pieces(n)).alias("at", "start")) for n in used]
    found = functools.reduce(DataFrame.unionByName, at).join(listed, ["q", "start"]).select("head", "at", F.explode("ns").alias("n")).where("at + n <= char_length(head)")
    parts = found.select(F.col("head").alias("large"), F.substring("head", F.col("at") + 1, F.col("n")).alias("small")).where("small <> large")
    return parts.distinct().join(short.select("small"), "small").select("small", "large")


def _near(met: DataFrame, distance: float) -> DataFrame:
    """(id, by) of those rows (id, v, by, w) whose vectors are nearer than `distance`, to six digits; vectors of unequal length never are."""
    kinds = dict(met.dtypes)

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            size = pa.compute.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                some = b.take(pa.array(np.flatnonzero(size == n)))
                x, y = matrix(some.column("v")), matrix(some.column("w"))
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                with np.errstate(invalid="ignore", divide="ignore"):
                    far = (1 - dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))).round(6)
                yield some.select(["id", "by"]).filter(pa.array(far < distance))

    return met.where("id <> by AND size(v) = size(w)").select("id", "v", "by", "w").mapInArrow(f, f"id {kinds['id']}, by {kinds['by']}")


def insert_duplicates(new: DataFrame, held: DataFrame, distance: float = 0.15, head: int = 100) -> DataFrame:
    """Ids of new rows to leave out: a held row, or a new row before it (by id) that is inserted, is nearer than `distance` and the first
    `head` characters of one text hold the other's, at any place. Rows are (id, content, embedding); empty heads and vectors without a length
    match nothing.

    Later copies of a new row (head and vector) share its fate or fall to it, so they go first. The others meet rows whose heads match, and
    of these alone vectors are compared: with the first few held rows of a head, then, if still there, with all of them, then with each
    other. Where many new rows are left of a head that holds no other and is held by none, its first is inserted and rules out its matches;
    for the rest, which rows are inserted is settled in rounds: a row that none before it may still rule out stays and rules out its matches.
    """

    def rows(df: DataFrame) -> DataFrame:
        has = df.select("id", F.substring("content", 1, head).alias("head"), F.col("embedding").alias("v")).where("head <> '' AND v IS NOT NULL")
        return has.where(vector.dot("v", "v") > 0)

    fresh, old = _cut(rows(new)), _cut(rows(held))
    first = fresh.where(F.round(1 - vector.cosine("v", "v"), 6) < distance).groupBy("head", "v").agg(F.min("id").alias("first"))
    copies = _cut(fresh.join(first, ["head", "v"]).where("id > first").select("id"))
    fresh = _cut(fresh.join(copies, "id", "left_anti"))
    within = _cut(holding(_cut(fresh.select("head").unionByName(old.select("head")).distinct()), head))
    apart = within.isEmpty()
    other = within.selectExpr("small AS head", "large AS other").unionByName(within.selectExpr("large AS head", "small AS other"))
    other = _cut(other.join(fresh.select("head").distinct(), "head", "left_semi"))

    def met(ours: DataFrame, theirs: DataFrame) -> DataFrame:
        theirs = theirs.select(F.col("id").alias("by"), "head", F.col("v").alias("w"))
        same = skew.product_join(ours, theirs, ["head"], "id", "by").select("id", "v", "by", "w")
        if apart:
            return _near(same, distance)
        more = skew.product_join(skew.product_join(ours, other, ["head"], "id", "other").drop("head"), theirs.withColumnRenamed("head", "other"), ["other"], "id", "by")
        return _near(same.unionByName(more.select("id", "v", "by", "w")), distance)

    gone = copies
    few = _cut(skew.top_per(old, ["head"], FIRST, [F.col("id")], "id").select("id", "head", "v"))
    many = old.join(old.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > FIRST).select("head"), "head", "left_semi")
    for theirs in (few, many):
        fell = _cut(met(fresh, theirs).select("id").distinct())
        gone, fresh = gone.unionByName(fell), _cut(fresh.join(fell, "id", "left_anti"))
    alone = fresh if apart else fresh.join(other.select("head").distinct(), "head", "left_anti")
    while True:
        firsts = _cut(alone.groupBy("head").agg(F.count("*").alias("n"), F.min("id").alias("by")).where(F.col("n") > LEAD))
        waiting = firsts.agg(F.sum("n")).first()[0]
        if not waiting:
            break
        led = firsts.select("head", "by").join(alone.select("head", F.col("id").alias("by"), F.col("v").alias("w")), ["head", "by"])
        fell = _cut(_near(alone.join(led, "head"), distance).select("id").distinct())
        done = fell.unionByName(firsts.select(F.col("by").alias("id")))
        gone, fresh, alone = gone.unionByName(fell), _cut(fresh.join(done, "id", "left_anti")), _cut(alone.join(done, "id", "left_anti"))
        if 4 * fell.count() < waiting:
            break
    left = _cut(met(fresh, fresh).where("by < id"))
    while True:
        if left.isEmpty():
            return gone.distinct()
        stays = left.select("by").distinct().join(left.select(F.col("id").alias("by")).distinct(), "by", "left_anti")
        fell = _cut(left.join(stays, "by", "left_semi").select("id").distinct())
        gone = gone.unionByName(fell)
        left = _cut(left.join(fell, "id", "left_anti").join(fell.select(F.col("id").alias("by")), "by", "left_anti"))


def retention(df: DataFrame, least: float = 0.3, recent: int = 100) -> DataFrame:
    """df with `action`: keep_recent for the newest `recent`, delete for the others below `least`, else keep.

    The newest are a bounded list found by top-k; no window over the table.
    """
    newest = df.where("ts IS NOT NULL").orderBy(F.desc("ts"), "id").limit(recent).select("id", F.lit(True).alias("newest"))
    marked = df.join(F.broadcast(newest), "id", "left")
    action = F.when(F.col("newest"), "keep_recent").when(F.col("importance") < least, "delete").otherwise("keep")
    return marked.withColumn("action", action).drop("newest")


def patched(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """df with the columns of `changes` put in by key where they aren't null."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in cols))
    out = df.join(new, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns))


def without(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """df without the rows whose keys `gone` lists."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def valid_importance(c: Column) -> Column:
    return F.when(c.between(0, 1), c)


def consolidated(pairs: DataFrame, rated: DataFrame) -> DataFrame:
    """(keep, gone, similarity): of each pair the more important, the first on ties."""
    r = rated.select("id", "importance")
    a, b = r.select(F.col("id").alias("a"), F.col("importance").alias("ia")), r.select(F.col("id").alias("b"), F.col("importance").alias("ib"))
    p = pairs.join(a, "a").join(b, "b")
    first = F.col("ia") >= F.col("ib")
    return p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("gone"), "similarity")


def latest(df: DataFrame, *keys: str, order: Column) -> DataFrame:
    """The last row of each key: max of (order, row), with a partial step."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select("r.*")


def last_window(keys: tuple[str, ...], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
