"""Collocations against brute force; automata against slices of word lists."""

import random
import re
from collections import Counter

import pytest

from memloom.llm import collocations as co


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, top):
    f, n = {}, Counter()
    for lang, text in docs:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for w in pieces(text):
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in inside):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    few = ["a", "the", "THE", "é", "b#", "字", "x\x00y", "longer-word-of-many-letters", "\xa0", "c"]
    rare = lambda: "".join(r.choice("pqrs") for _ in range(r.randint(1, 4)))
    docs = []
    for _ in range(120):
        words = [r.choice(few) if r.random() < 0.8 else rare() for _ in range(r.randint(0, 120))]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", " \r\n", "\x0b"]) for w in words)
        docs.append((r.choice(["en", "en", "en", None, "und", ""]), r.choice([text, text, text, text, None, "", docs[-1][1] if docs else ""])))
    docs += [("aa", "a " * 40), ("aa", "a a a a"), ("bb", "x y z w. " * 40)]
    return docs


@pytest.mark.parametrize(("seed", "least", "top", "chunk", "piece", "patterns"), [(0, 30, 2000, 8_000_000, 8_000_000, 150_000), (1, 5, 40, 3000, 700, 50), (2, 3, 2000, 500, 64, 7)])
def test_collocations_are_brute_force(spark, seed, least, top, chunk, piece, patterns, monkeypatch):
    monkeypatch.setattr(co, "CHUNK", chunk)
    monkeypatch.setattr(co, "SLICE", piece)
    monkeypatch.setattr(co, "PATTERNS", patterns)
    docs = made(seed)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, n int, phrase int").repartition(3)
    got = co.collocations(df, least, top)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top)


def test_empty_tables(spark):
    df = spark.createDataFrame([(None, None), ("en", " .,")], "lang string, text string")
    assert co.collocations(df).count() == 0 == co.collocations(df.where("false")).count()


def test_scores_past_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a b", 2, big // 2 + 1), ("en", "a", 1, big // 2 + 1), ("en", "b", 1, big // 2 + 2), ("en", "", 0, big)]
    f = spark.createDataFrame(rows, "lang string, phrase string, k int, n long")
    assert co.scored(f).collect()[0].score == 2000000 * rows[0][3] // (rows[1][3] + rows[2][3])


def test_automata_count_overlaps_and_whole_words():
    s = co.plain([b"a a a aa a a.a a", b"A\ta"]).decode()
    phrases = [(b"a a", 2), (b"a a a", 3), (b"a aa", 2)]
    assert co.scanned(s, phrases).tolist() == [5, 1, 1]


def test_sketch_never_falls_below_a_count(spark, monkeypatch):
    """With a sketch so small that all cells collide, candidates are more, and results the same."""
    monkeypatch.setattr(co, "sketch_bits", lambda n: (4, 3))
    docs = made(7)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert sorted(map(tuple, co.collocations(df, 5).collect())) == brute(docs, 5, co.TOP)
