"""Quality rules as a short-circuit cascade.

A rule rejects a text. On a bounded sample the cascade measures what each rule costs a text and what share of the texts
that reach it it rejects, then runs the rules in falling order of rejection per cost; a text that one rule rejects meets no
further rule. The verdict doesn't depend on the order, only the work does.

Nulls and texts without words: no words, all counts 0; the base rule rejects them. Repeated rows are judged one by one. Null doc_id: kept. An
empty table gives no rows. A very long text is one row, judged whole. Extra columns are kept; apply_cascade's column has a name that the
caller may choose and replaces a column of that name. The sample's texts are cut to SAMPLE_CHARS on their way to the driver; they decide on the
rules' order only.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.common import WORD_PATTERN, lean, small_batches, texts_of

_WORD = re.compile(WORD_PATTERN)
#: A letter is a character of Unicode's categories L; most words show one at their first character or hold ASCII letters.
_ASCII_LETTER = re.compile(r"[A-Za-z]")
SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Features:
    """What rules look at, each worked out when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_lettered(self) -> int:
        return sum(1 for w in self.words if lettered(w))


def lettered(word: str) -> bool:
    """Has the word a letter? Numbers that aren't digits, such as ² or Ⅷ, are none."""
    return _ASCII_LETTER.search(word) is not None or not word.isascii() and any(map(str.isalpha, word))


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs at least twice, the first occurrence included.

    Windows are told apart by hash first; equal hashes are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    starts = np.flatnonzero(np.r_[True, ~same])
    for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
        if b - a > 1:
            groups: dict[tuple, list[int]] = {}
            for at in order[a:b]:
                groups.setdefault(tuple(ids[at : at + window].tolist()), []).append(int(at))
            for g in groups.values():
                if len(g) > 1:
                    twice[g] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_fails(x: Features) -> bool:
    """Too few words, or over 30 % of them in repeated windows."""
    return x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words


@dataclass(frozen=True)
class Rule:
    """rejects(features) is true for a text to drop."""

    name: str
    rejects: Callable[[Features], bool]


#: The verdict's rules; thresholds are integers so that SQL gives the same.
RULES = (
    Rule("symbols", lambda x: x.n_symbols > x.n_words),
    Rule("word_length", lambda x: x.word_chars < 2 * x.n_words or x.word_chars > 20 * x.n_words),
    Rule("lettered", lambda x: 10 * x.n_lettered < 4 * x.n_words),
    Rule("dup_lines", lambda x: x.n_dup_lines >= 3 and 10 * x.n_dup_lines > 3 * len(x.lines)),
)
BASE = Rule("base", base_fails)
#: Texts of the sample on which costs and selectivities are estimated.
SAMPLE = 400
SAMPLE_CHARS = 20_000


@dataclass(frozen=True)
class Measured:
    """A rule's place in the cascade: seconds a text, and the share of the texts reaching it that it rejects."""

    rule: Rule
    cost: float
    rejected: float


def plan_cascade(texts: list[str], rules: tuple[Rule, ...]) -> list[Measured]:
    """Order the rules greedily by rejection per cost on the texts that the rules before them leave."""
    left, out, todo = list(texts), [], list(rules)
    while todo:
        tried = []
        for r in todo:
            fresh = [Features(t) for t in left]
            began = time.perf_counter()
            hits = [r.rejects(x) for x in fresh]
            cost = (time.perf_counter() - began) / max(1, len(left)) + 1e-9
            tried.append((sum(hits) / max(1, len(left)) / cost, -cost, r, hits))
        score, cost, best, hits = max(tried, key=lambda x: x[:2])
        out.append(Measured(best, -cost, score * -cost))
        left = [t for t, h in zip(left, hits, strict=True) if not h]
        todo.remove(best)
    return out


def sampled(docs: DataFrame, n: int = SAMPLE) -> list[str]:
    """A bounded sample of texts for the estimates: the first rows of the table, which decide on order only, never on a verdict."""
    return [r[0] or "" for r in docs.select(F.substring("text", 1, SAMPLE_CHARS)).limit(n).collect()]


def run_cascade(features: list[Features], plan: list[Measured]) -> list[str | None]:
    """The rule that rejects each text, or None. Later rules see only what is left."""
    out: list[str | None] = [None] * len(features)
    left = list(range(len(features)))
    for m in plan:
        keep = []
        for i in left:
            if m.rule.rejects(features[i]):
                out[i] = m.rule.name
            else:
                keep.append(i)
        left = keep
    return out


def apply_cascade(docs: DataFrame, rules: tuple[Rule, ...] = (BASE, *RULES), sample: int = SAMPLE, to: str = "rejected_by") -> DataFrame:
    """docs with the name of the rule that rejects a text in column `to` (null: kept)."""
    small_batches(docs.sparkSession)
    plan = plan_cascade(sampled(docs, sample), rules)
    docs = docs.drop(to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            verdict = run_cascade([Features(t) for t in texts_of(b)], plan)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(verdict, pa.string())], [*b.schema.names, to])

    return docs.mapInArrow(lean(run), schema)


METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The base counts of every document with the cascade's verdict; rules run only on what the base rule leaves."""
    small_batches(docs.sparkSession)
    plan = plan_cascade(sampled(docs, sample), RULES)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            fs = [Features(t) for t in texts_of(b)]
            failed = [base_fails(x) for x in fs]
            rest = [i for i, f in enumerate(failed) if not f]
            kept = [False] * len(fs)
            for i, by in zip(rest, run_cascade([fs[i] for i in rest], plan), strict=True):
                kept[i] = by is None
            counts = [pa.array([getattr(x, k) for x in fs], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], [x.split()[0] for x in METRICS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), METRICS)
