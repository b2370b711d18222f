"""Duplicates of an insert batch are found by their heads, and only rows of matching heads have their vectors compared."""

import random

import numpy as np
import pytest

from memloom.operators import dedup, metric_join


@pytest.mark.parametrize("seed", [0, 1])
def test_texts_that_hold_others(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "a", "é", "server", "aaaa", "zz", " ", "😀x"])
    heads = {"".join(word() for _ in range(r.randint(1, 24)))[:60] for _ in range(150)} | {"a" * k for k in (1, 2, 3, 15, 16, 17, 59, 60)}
    want = {(a, b) for a in heads for b in heads if a != b and a in b}
    got = [tuple(x) for x in dedup.holding(spark.createDataFrame([(h,) for h in heads], "head string"), 60).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def far_apart(batch, store, distance, head=100):
    """The service's loop, row by row."""
    kept, out = list(store), set()
    for i, t, v in batch:
        def near(w):
            n = np.linalg.norm(v) * np.linalg.norm(w)
            return n > 0 and round(1 - float(np.dot(v, w)) / n, 6) < distance
        if any((s[:head] in t[:head] or t[:head] in s[:head]) and near(w) for _, s, w in kept):
            out.add(i)
        else:
            kept.append((i, t, v))
    return out


@pytest.mark.parametrize(("seed", "lead", "first", "distance"), [(0, 4, 1, 1.15), (1, 2, 2, 0.5), (2, 64, 8, 1.0), (3, 1, 1, 0.05)])
def test_large_groups_of_one_head_are_the_loop(spark, seed, lead, first, distance, monkeypatch):
    monkeypatch.setattr(dedup, "LEAD", lead)
    monkeypatch.setattr(dedup, "FIRST", first)
    r = random.Random(seed)
    v = lambda: [r.gauss(0, 1) for _ in range(3)] if r.random() < 0.95 else [0.0] * 3
    t = lambda: r.choice(["one head of many rows", "one head of many rows", "another head that new rows alone have", "head", f"text {r.randrange(60)}"])
    batch = [(k, t(), v()) for k in range(160)]
    store = [(k, x, v()) for k in range(200, 230) if not (x := t()).startswith("another")]
    df = [spark.createDataFrame(x, "id long, content string, embedding array<double>") for x in (batch, store)]
    assert {x.id for x in dedup.insert_duplicates(*df, distance=distance).collect()} == far_apart(batch, store, distance)


def test_vectors_meet_only_under_matching_heads(spark, monkeypatch):
    """With a distance that rules nothing out, 2000 texts of their own and 40 copies: no pairs of tiles, and about as many pairs as copies."""
    monkeypatch.setattr(metric_join, "compared", lambda *a, **b: pytest.fail("all pairs of vectors were compared"))
    seen, near = [], dedup._near
    monkeypatch.setattr(dedup, "_near", lambda met, distance: (seen.append(met.count()), near(met, distance))[1])
    rows = [(k, f"{k % 2000:06d} is the number of this text " + "x" * 80, [1.0, k / 5000]) for k in range(2040)]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<double>")
    assert {x.id for x in dedup.insert_duplicates(df.where("id >= 1000"), df.where("id < 1000"), distance=1.15).collect()} == set(range(2000, 2040))
    assert sum(seen) < 3 * 2040
