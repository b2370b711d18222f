"""Places where a model plugs in: embedding, extraction, facts. Deterministic stand-ins serve where no model is given."""

from __future__ import annotations

import hashlib
import mimetypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import entities as ent
from memloom.functions import text as fn

Embedder = Callable[[list[str]], list[list[float] | None]]


def hash_embedder(dims: int = 384) -> Embedder:
    """Words hashed into signed buckets, unit length: equal texts agree, texts that share words are near. No words: null."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def _alone(model: Embedder, text: str) -> list[float] | None:
    try:
        return model([text])[0]
    except Exception:
        return None


def embedded(df: DataFrame, column: str, make: Callable[[], Embedder] = hash_embedder, to: str = "embedding", retries: int = 3) -> DataFrame:
    """df with vectors of a text column; the model is made once a task. What fails `retries` times is null, never zeros."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            for left in range(retries - 1, -1, -1):
                try:
                    yield pd.Series(model(s.fillna("").tolist()))
                    break
                except Exception:
                    if not left:  # one bad row must not cost the batch its vectors
                        yield pd.Series([_alone(model, t) for t in s.fillna("")])

    return df.withColumn(to, run(fn.clean_for_embedding(column, 1500)))


RESULT = "entities array<struct<name:string,type:string,confidence:double>>, relations array<struct<source:string,relation:string,target:string,confidence:double>>"
Extractor = Callable[[str], dict]


def parsed(answer: Column) -> Column:
    """A model's answer as entities and relations, however it is wrapped; null where it isn't JSON."""
    return fn.lenient_json(answer, RESULT)


def rules(text: Column | str) -> Column:
    """The rule extractor: entities of all types with confidence .7, no relations."""
    found = F.transform(ent.extracted(text), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.lit(0.7).alias("confidence")))
    return F.struct(found.alias("entities"), F.expr("CAST(array() AS array<struct<source:string,relation:string,target:string,confidence:double>>)").alias("relations"))


def extracted(df: DataFrame, text: str, make: Callable[[], Extractor] | None = None) -> DataFrame:
    """df with `entities` and `relations` of the first 2000 characters, by a model or by rules."""
    head = F.substring(text, 1, 2000)
    if make is None:
        return df.withColumn("_r", rules(head)).select(*df.columns, "_r.*")

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for s in batches:
            got = [model(t) if t else {} for t in s]
            yield pd.DataFrame({"entities": [g.get("entities", []) for g in got], "relations": [g.get("relations", []) for g in got]})

    return df.withColumn("_r", run(head)).select(*df.columns, "_r.*")


def checked(df: DataFrame, text: str) -> DataFrame:
    """Entities that are valid and in the text or sure, once each, with their type inferred; relations with both ends among them."""
    low = F.lower(text)
    keep = F.filter("entities", lambda e: ent.valid_entity(e["name"]) & (low.contains(F.lower(e["name"])) | (e["confidence"] >= 0.9)))
    typed = F.transform(keep, lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], ent.infer_type(e["name"])).alias("type"), F.least(F.greatest(F.coalesce(e["confidence"], F.lit(0.5)), F.lit(0.1)), F.lit(1.0)).alias("confidence")))
    out = df.withColumn("entities", F.array_distinct(typed))
    names = F.transform("entities", lambda e: e["name"])
    return out.withColumn("relations", F.filter("relations", lambda r: F.array_contains(names, r["source"]) & F.array_contains(names, r["target"])))


#: Conjunctions that make a sentence hard for the small model.
HARD = ("因为", "所以", "但是", "虽然", "如果", "那么", "不仅", "而且")


def route(text: Column | str, small: bool = True) -> Column:
    """Which extractor a text goes to: short and plain ones to the small model where there is one."""
    t = F.col(text) if isinstance(text, str) else text
    if not small:
        return F.lit("large")
    return F.when(fn.any_of(t, HARD), "large").when(F.length(t) < 100, "small").otherwise("large")


def needs_verification(sure: float = 0.8) -> Column:
    """No entity, or an entity or a relation below `sure`."""
    low = lambda c: F.exists(c, lambda x: F.coalesce(x["confidence"], F.lit(0.0)) < sure)
    return (F.size("entities") == 0) | low("entities") | low("relations")


def routed(df: DataFrame, text: str, small: Callable[[], Extractor] | None, large: Callable[[], Extractor] | None, verify: bool = True, sure: float = 0.8) -> DataFrame:
    """df with `entities`, `relations` and `backend`: hard and long texts go to the large extractor, others to the small one; what the small one
    isn't sure of goes to the large one too (small+large). Rules stand in for an extractor that isn't given."""
    way = df.withColumn("_way", route(text))
    first = extracted(way.where("_way = 'small'"), text, small)
    hard = extracted(way.where(F.coalesce(F.col("_way") != "small", F.lit(True))), text, large).withColumn("backend", F.lit("large"))
    if not verify:
        return first.withColumn("backend", F.lit("small")).unionByName(hard).drop("_way")
    doubt = F.coalesce(needs_verification(sure), F.lit(True))
    kept = first.where(~doubt).withColumn("backend", F.lit("small"))
    again = extracted(first.where(doubt).select(*way.columns), text, large).withColumn("backend", F.lit("small+large"))
    return kept.unionByName(again).unionByName(hard).drop("_way")


def in_stages(df: DataFrame, key: str, text: str, aliases: DataFrame, known: DataFrame, make: Callable[[], Extractor] | None = None, head: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extraction in three stages: entities, relations between them, names resolved. (entities, relations, stats) by `key`.

    entities: (key, name, canonical, type, confidence, is_existing, source_text); relations have their ends under their canonical names, and those
    whose ends aren't among a text's entities go; stats: (key, entity_count, relation_count, new_entities). Texts without entities have
    no relations. aliases: (alias, canonical); known: (name,), what the graph has.
    """
    found = checked(extracted(df, text, make), text)
    e = found.select(key, F.substring(text, 1, head).alias("source_text"), F.explode("entities").alias("e")).select(key, "source_text", "e.*")
    low = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.min("canonical").alias("_c"))
    has = known.select(F.lower("name").alias("_n")).distinct().withColumn("_has", F.lit(True))
    named = lambda d, c, to: d.join(low, F.lower(F.col(c)) == F.col("_a"), "left").withColumn(to, F.coalesce("_c", c)).drop("_a", "_c")
    e = named(e, "name", "canonical").join(has, F.lower("canonical") == F.col("_n"), "left").withColumn("is_existing", F.coalesce("_has", F.lit(False))).drop("_n", "_has")
    r = found.select(key, F.substring(text, 1, head).alias("source_text"), F.explode("relations").alias("r")).select(key, "source_text", "r.*")
    for end in ("source", "target"):
        r = named(r, end, f"_{end}").drop(end).withColumnRenamed(f"_{end}", end)
    r = r.where("source <> target").select(key, "source", "relation", "target", "confidence", "source_text")
    n = e.groupBy(key).agg(F.count("*").alias("entity_count"), F.count_if(~F.col("is_existing")).alias("new_entities"))
    m = r.groupBy(key).agg(F.count("*").alias("relation_count"))
    stats = n.join(m, key, "left").select(key, "entity_count", F.coalesce("relation_count", F.lit(0)).alias("relation_count"), "new_entities")
    return e.select(key, "name", "canonical", "type", "confidence", "is_existing", "source_text"), r, stats


def new_facts(new: DataFrame, held: DataFrame, least: float = 0.8) -> DataFrame:
    """new (owner, fact) with `event`: NONE where a fact of the same owner is as good as equal, else ADD."""
    pairs = new.select("owner", "fact").distinct().join(held.select("owner", F.col("fact").alias("_h")).distinct(), "owner")
    same = pairs.where(fn.jaccard("fact", "_h") > least).select("owner", "fact").distinct().withColumn("_same", F.lit(True))
    return new.join(same, ["owner", "fact"], "left").withColumn("event", F.when(F.col("_same"), "NONE").otherwise("ADD")).drop("_same")


#: Kinds of files that the platform's table may not know.
MORE_KINDS = {".webp": "image/webp", ".md": "text/markdown", ".m4a": "audio/m4a"}
#: Kinds that count as documents.
DOCUMENTS = ("application/pdf", "text/plain", "text/markdown")


def file_kind(path: Column | str) -> Column:
    """image, audio, video, document or other, by the MIME type of a name's extension."""
    types = MORE_KINDS | mimetypes.types_map
    groups = {k: [e for e, m in types.items() if m.startswith(k + "/")] for k in ("image", "audio", "video")} | {"document": [e for e, m in types.items() if m in DOCUMENTS]}
    p = F.col(path) if isinstance(path, str) else path
    ext = F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))
    out = F.when(ext.isin(*groups["image"]), "image")
    for k in ("audio", "video", "document"):
        out = out.when(ext.isin(*groups[k]), k)
    return out.otherwise("other")


def kind_counts(rows: DataFrame) -> DataFrame:
    """(content_type, n): how many rows each kind has; rows without a kind are texts."""
    return rows.groupBy(F.coalesce("content_type", F.lit("text")).alias("content_type")).agg(F.count("*").alias("n"))


def merged_facts(held: DataFrame, new: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(owner, fact, event) after a merge: held facts stay (NONE), go (DELETE) or are replaced (UPDATE), new ones come (ADD) or are held (NONE).

    decisions (owner, fact, event, text) are a model's, one for each held fact that it changes: UPDATE puts text in the fact's place. Without
    a model, a new fact that is as good as a held one changes nothing. Facts that a decision wrote are not added again.
    """
    base = held.select("owner", "fact").distinct()
    if decisions is None:
        kept = base.withColumn("event", F.lit("NONE"))
    else:
        d = decisions.groupBy("owner", "fact").agg(F.max(F.struct("event", "text")).alias("d"))
        told = base.join(d, ["owner", "fact"], "left")
        updated = (F.col("d.event") == "UPDATE") & F.col("d.text").isNotNull()
        kept = told.select("owner", F.when(updated, F.col("d.text")).otherwise(F.col("fact")).alias("fact"), F.when(updated, "UPDATE").when(F.col("d.event") == "DELETE", "DELETE").otherwise("NONE").alias("event"))
    fresh = new_facts(new, kept.where("event <> 'DELETE'").select("owner", "fact").unionByName(base)).where("event = 'ADD'").select("owner", "fact", "event").distinct()
    return kept.unionByName(fresh)


def incremental(df: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of extracted rows that the graph (source, relation, target) doesn't hold: names of two characters or more."""
    known = held.select(F.col("source").alias("name")).unionByName(held.select(F.col("target").alias("name"))).distinct()
    e = df.select(F.explode("entities").alias("e")).select(F.trim("e.name").alias("name"), F.coalesce("e.type", F.lit("概念")).alias("type"), F.coalesce("e.confidence", F.lit(0.8)).alias("confidence"))
    e = e.where(F.length("name") >= 2).groupBy("name").agg(F.max_by("type", "confidence").alias("type"), F.max("confidence").alias("confidence"))
    r = df.select(F.explode("relations").alias("r")).select(F.trim("r.source").alias("source"), F.coalesce("r.relation", F.lit("相关")).alias("relation"), F.trim("r.target").alias("target"), F.coalesce("r.confidence", F.lit(0.7)).alias("confidence"))
    r = r.where("source <> '' AND target <> ''").groupBy("source", "relation", "target").agg(F.max("confidence").alias("confidence"))
    return e.join(known, "name", "left_anti"), r.join(held.select("source", "relation", "target"), ["source", "relation", "target"], "left_anti")


def in_steps(df: DataFrame, text: str, find: Callable[[], Extractor] | None = None, pair: Callable[[Column, Column], Column] | None = None, name: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Extraction in four steps: entities, pairs of them, a type for each pair, normal names. df with `entities` and `relations`.

    find is a model that gives entities (rules without one); pair says which two entities belong together (names in one sentence without one);
    name gives their relation's type (相关 without one). Pairs are those of one text; a text has few entities.
    """
    full = F.col(text)
    found = checked(extracted(df, text, find), text)
    names = F.array_sort(F.array_distinct(F.transform("entities", lambda e: F.trim(e["name"]))))
    sentences = F.split(full, r"[。！？.!?\n]")
    near = pair or (lambda a, b: F.exists(sentences, lambda s: s.contains(a) & s.contains(b)))
    kind = name or (lambda a, b, t: F.lit("相关"))
    pairs = F.flatten(F.transform("_names", lambda a: F.transform(F.filter("_names", lambda b: (a < b) & near(a, b)), lambda b: F.struct(a.alias("source"), F.coalesce(kind(a, b, full), F.lit("相关")).alias("relation"), b.alias("target"), F.lit(0.7).alias("confidence")))))
    return found.withColumn("_names", names).withColumn("relations", pairs).drop("_names")
