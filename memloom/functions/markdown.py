"""Entities and relations that a workspace's Markdown states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import entities as ent

#: Keys whose values are kept out, and words that mark a role.
SECRET = r"(?i)password|token|secret|密码|口令|密钥"
ROLE = r"(?:我是|我叫|角色[:：]|Role[:：])\s*([^\s，。,.]{2,20})"


def _items(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?m)" + pattern), F.lit(group))


def extracted(files: DataFrame, text: str = "content", name: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of Markdown files.

    Headings of 3 to 49 characters are concepts; `- **key**: value` gives the value as an entity and has_key as the file's relation, unless
    the key speaks of a secret; list items of 6 to 99 characters that open no link give an entity of inferred type, 50 characters of
    it; a stated role is a person. Equal names of a type come once.
    """
    t = F.col(text)
    title = F.transform(F.filter(_items(t, r"^#{1,6}\s+(.+?)\s*$", 1), lambda h: F.length(h).between(3, 49)), lambda h: F.struct(h.alias("name"), F.lit("概念").alias("type")))
    keys, values = (_items(t, r"^\s*[-*]\s+\*\*([^*:：]+)\*\*\s*[:：]\s*(.+?)\s*$", k) for k in (1, 2))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: ~p["k"].rlike(SECRET))
    stated = F.transform(pairs, lambda p: F.struct(F.substring(p["v"], 1, 50).alias("name"), ent.infer_type(p["v"]).alias("type")))
    plain = F.filter(_items(t, r"^\s*[-*]\s+([^\[*\s].*?)\s*$", 1), lambda x: F.length(x).between(6, 99))
    listed = F.transform(plain, lambda x: F.struct(F.substring(x, 1, 50).alias("name"), ent.infer_type(x).alias("type")))
    roles = F.transform(_items(t, ROLE, 1), lambda x: F.struct(x.alias("name"), F.lit("人物").alias("type")))
    found = files.select(F.explode(F.flatten(F.array(title, stated, listed, roles))).alias("e")).select("e.*").distinct()
    rel = files.select(F.col(name).alias("source"), F.explode(pairs).alias("p")).select("source", F.concat(F.lit("has_"), F.translate(F.trim("p.k"), " ", "_")).alias("relation"), F.substring("p.v", 1, 50).alias("target"))
    return found, rel.distinct()
