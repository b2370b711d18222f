"""Entities with their places: one Aho-Corasick automaton over all dictionaries, and patterns, in one Arrow pass over the texts.

Places are code points from 0, ends are exclusive. The automaton reads each text once, however many names there are; names searched in any
case are matched without regard to the case of A-Z. Null and empty texts have no entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import entities as ent

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HAN = "一-龥"
#: Dictionaries by type, and whether case counts.
DICTIONARIES = (("technology", ent.TECHNOLOGY, False), ("organization", ent.ORGANISATIONS, True), ("location", ent.PLACES, True))
#: Patterns by type; what group 1 holds is the name.
PATTERNS = (
    ("person", rf"([{ent.SURNAMES}][{_HAN}]{{1,3}})(?=[{''.join(ent.AFTER_NAME)}])"),
    ("name", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"),
    ("organization", rf"([{_HAN}]{{2,8}}(?:公司|集团|科技|网络|信息|数据))"),
    ("project", rf"([{_HAN}A-Za-z0-9_]+)(?=项目|系统|平台|服务|模块)"),
)
#: The patterns that stand in for a trained tagger.
TAGGER = (
    ("组织", rf"([{_HAN}]+公司)"),
    ("组织", rf"([{_HAN}]+集团)"),
    ("项目", rf"([{_HAN}]+项目)"),
    ("项目", rf"([{_HAN}]+系统)"),
    ("技术", r"(Python|Java|React|Vue|Docker|Kubernetes)"),
    ("地点", rf"([{_HAN}]+[省市县])"),
)
_NO_NAMES = frozenset(ent.COMMON) | frozenset(ent.TECHNOLOGY)


@cache
def _automaton() -> ahocorasick.Automaton:
    names: dict[str, list[tuple[str, str, bool]]] = {}
    for kind, words, cased in DICTIONARIES:
        for w in words:
            names.setdefault(w.translate(_LOWER), []).append((kind, w, cased))
    a = ahocorasick.Automaton()
    for low, found in names.items():
        a.add_word(low, (len(low), found))
    a.make_automaton()
    return a


@cache
def _patterns(which: tuple[tuple[str, str], ...]) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p, re.ASCII)) for kind, p in which]


def _wanted(kind: str, name: str) -> bool:
    if kind == "name":
        return len(name) > 2 and name not in _NO_NAMES
    return kind != "project" or len(name) >= 2


def found(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(type, name, start, end) of each occurrence in a text; English names are persons."""
    for last, (size, names) in _automaton().iter(text.translate(_LOWER)):
        a, b = last + 1 - size, last + 1
        for kind, name, cased in names:
            if not cased or text[a:b] == name:
                yield kind, name, a, b
    for kind, p in _patterns(PATTERNS):
        for m in p.finditer(text):
            if _wanted(kind, m[1]):
                yield "person" if kind == "name" else kind, m[1], m.start(1), m.end(1)


def tagged(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(type, name, start, end) by the tagger's patterns, each by itself; names of two characters or more."""
    for kind, p in _patterns(TAGGER):
        for m in p.finditer(text):
            if len(m[1]) >= 2:
                yield kind, m[1], m.start(), m.end()


def _rows(df: DataFrame, key: str, text: str, each, first: bool) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, out = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                got = each(t) if t else ()
                if first:
                    seen: dict[tuple[str, str], list[int]] = {}
                    for kd, name, a, z in got:
                        x = seen.setdefault((kd, name), [a, z, 0])
                        x[:2] = min(x[:2], [a, z])
                        x[2] += 1
                    got = [(kd, name, *x) for (kd, name), x in seen.items()]
                else:
                    got = [(*x, 1) for x in got]
                out += got
                at += [k] * len(got)
                while len(out) >= 50_000:
                    yield batch(b, at[:50_000], out[:50_000])
                    at, out = at[50_000:], out[50_000:]
            yield batch(b, at, out)

    def batch(b: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        kinds, names, starts, ends, n = zip(*out, strict=True) if out else ((),) * 5
        return pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(n, pa.int32())], ["key", "type", "name", "start", "end", "n"])

    got = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(f, f"key {kind}, type string, name string, start int, end int, n int")
    return got.withColumnRenamed("key", key)


def entities(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, type, name, start, end, n): each entity of each text by the six rules, where it first stands and how often; as
    functions.entities.extracted names them, but for case outside A-Z."""
    return _rows(df, key, text, found, True)


def spans(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, type, name, start, end, n): every match of the tagger's patterns, confidence .7."""
    return _rows(df, key, text, tagged, False).drop("n").withColumn("confidence", F.lit(0.7))
