"""A recall from question to context: decide, retrieve, compress to a budget."""

from __future__ import annotations

import datetime as dt

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import compress, filters, fusion, lexical, vector
from memloom.plans import intent

CONTEXT = "id long, text string, score double"


def retrieve(memories: DataFrame, question: str, query_vector: list[float], now: dt.datetime, limit: int) -> DataFrame:
    """(id, score) by the mode that the question asks for; a named time is filtered before anything is ranked.

    memories: (id, content, importance, ts, embedding).
    """
    seen = intent.recognise(question, now)
    if seen.anchor.lo is not None:
        memories = filters.within(memories, seen.anchor.lo, seen.anchor.hi)
    terms = tuple(dict.fromkeys(regex.findall(lexical.QUERY_TOKEN, seen.anchor.cleaned.lower())))
    near = vector.with_distance(memories, query_vector)
    if seen.mode == "vector" or not terms:
        return vector.top_k(near.select("id", F.round(1 - F.col("distance"), 6).alias("score")), limit, F.desc("score"))
    words = lexical.bm25(memories, "content", terms)
    if seen.mode == "bm25":
        return vector.top_k(words, limit, F.desc("score"))
    return fusion.recall(near, words, memories.select("id", "ts"), F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"), limit)


def context(memories: DataFrame, question: str, query_vector: list[float], now: dt.datetime, tokens: int = 1000, force: bool = False) -> DataFrame:
    """(id, text, score) to put before a model: nothing where no recall is due, tags, summaries or fuller texts within the budget."""
    d = intent.decide(question)
    if not d.should_recall and not force:
        return memories.sparkSession.createDataFrame([], CONTEXT)
    limit = d.memory_limit or 5
    hits = retrieve(memories, question, query_vector, now, limit)
    page = memories.select("id", "content").join(F.broadcast(hits), "id")  # at most `limit` rows
    if d.level == "tags":
        return page.select("id", compress.tags("content").alias("text"), "score")
    ratio = 0.7 if d.level == "full" else d.compression
    most = int(tokens * 1.5 * (1 if d.level == "full" else ratio))
    folded = compress.budget(page, most, -F.col("score"), compress.compress("content", ratio), compress.compress("content", ratio / 2))
    return folded.join(hits, "id").select("id", "text", "score")
