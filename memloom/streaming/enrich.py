"""Enrichment of stored memories as a stage of its own: facts by a model slot, with retries, from a stream or over a table.

The stage reads memories and gives updates; it never writes them itself, and never deletes. A text that the model fails on waits in state for a
timer, twice as long after each failure; after RETRIES failures the memory stays as it is. A restarted query goes on with what waited. What
a stream gives out in the end is what `over` gives for the same rows and a model that recovers.

The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass), as Spark's stateful processors ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memloom.functions import text as fn
from memloom.operators.models import Embedder, hash_embedder

RETRIES, WAIT_MS, KEYWORDS, SUMMARY = 3, 30_000, 6, 3
UPDATES = "id string, summary string, facts array<string>, keywords array<string>, importance double, embedding array<float>"
#: A text's facts and the importance of each.
FactModel = Callable[[str], tuple[list[str], list[float]]]


def _update(key: str, text: str, model: FactModel, embed: Embedder) -> dict | None:
    """One row of UPDATES, or None for a text without facts. The vector is that of the new summary."""
    facts, weights = model(text)
    if not facts:
        return None
    summary = "; ".join(facts[:SUMMARY])
    return {"id": key, "summary": summary, "facts": facts, "keywords": facts[:KEYWORDS], "importance": sum(weights) / len(weights) if weights else 0.5, "embedding": embed([summary])[0]}


_COLUMNS = [x.split()[0] for x in UPDATES.split(", ")]


class Enricher(StatefulProcessor):
    """A memory's text while the model fails on it, and how often it has."""

    def __init__(self, make: Callable[[], FactModel], embedder: Callable[[], Embedder], retries: int, wait_ms: int):
        self.make, self.embedder, self.retries, self.wait_ms = make, embedder, retries, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.model, self.embed = handle, self.make(), self.embedder()
        self.waiting = handle.getValueState("waiting", "content string, failures int")

    def _try(self, key: tuple, text: str, failures: int, now: int) -> Iterator[pd.DataFrame]:
        try:
            row = _update(key[0], text, self.model, self.embed)
        except Exception:
            if failures + 1 < self.retries:
                self.waiting.update((text, failures + 1))
                self.handle.registerTimer(now + self.wait_ms * 2**failures)
            else:
                self.waiting.clear()
            return
        self.waiting.clear()
        if row is not None:
            yield pd.DataFrame([row], columns=_COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A later text of the same memory takes the place of an earlier one."""
        texts = [t for p in rows for t in p["content"].tolist()]
        if texts and texts[-1]:
            yield from self._try(key, texts[-1], 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            text, failures = self.waiting.get()
            yield from self._try(key, text, failures, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stream(memories: DataFrame, make: Callable[[], FactModel], embedder: Callable[[], Embedder] = hash_embedder, retries: int = RETRIES, wait_ms: int = WAIT_MS) -> DataFrame:
    """Updates for a stream of memories (id, content)."""
    return memories.select("id", "content").groupBy("id").transformWithStateInPandas(statefulProcessor=Enricher(make, embedder, retries, wait_ms), outputStructType=UPDATES, outputMode="Update", timeMode="ProcessingTime")


def over(memories: DataFrame, make: Callable[[], FactModel], embedder: Callable[[], Embedder] = hash_embedder, retries: int = RETRIES) -> DataFrame:
    """The same for a table: a text that fails `retries` times gives no row."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, embed = make(), embedder()
        for p in pages:
            out = []
            for key, text in zip(p["id"], p["content"], strict=True):
                for _ in range(retries if text else 0):
                    try:
                        out.append(_update(key, text, model, embed))
                        break
                    except Exception:
                        continue
            yield pd.DataFrame([x for x in out if x is not None], columns=_COLUMNS)

    return memories.select("id", "content").mapInPandas(run, UPDATES)


def by_rules(memories: DataFrame, ends: str = r"[。！？\n.!?]", most: int = 5) -> DataFrame:
    """(id, summary, facts, keywords, importance) without a model, as column expressions: a fact for each of the first sentences."""
    sentences = F.filter(F.transform(F.split("content", ends), lambda s: F.trim(s)), lambda s: s != "")
    facts = F.slice(F.array_distinct(F.transform(sentences, lambda s: F.substring(s, 1, 50))), 1, most)
    m = memories.select("id", facts.alias("facts")).where(F.size("facts") > 0)
    weights = F.transform("facts", lambda f: fn.importance(f))
    mean = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / F.size("facts")
    return m.select("id", F.array_join(F.slice("facts", 1, SUMMARY), "; ").alias("summary"), "facts", F.slice("facts", 1, KEYWORDS).alias("keywords"), F.round(mean, 6).alias("importance"))


def core_facts(text: str) -> tuple[list[str], list[float]]:
    """A stand-in model in plain Python, for streams: the first sentences, each of importance .5 and more for digits."""
    import re

    found = list(dict.fromkeys(s.strip()[:50] for s in re.split(r"[。！？\n.!?]", text) if s.strip()))[:5]
    return found, [0.6 if re.search("[0-9]", f) else 0.5 for f in found]


def merged(held: DataFrame, updates: DataFrame) -> DataFrame:
    """held with the columns of the updates that it has; memories without an update stay as they are. One update for each id."""
    cols = [c for c in updates.columns if c != "id" and c in held.columns]
    u = updates.select("id", F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in cols))
    j = held.join(u, "id", "left")
    return j.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in held.columns))
