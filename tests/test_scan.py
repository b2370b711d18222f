"""Folds over long groups against a plain loop."""

import random
from collections import defaultdict

import pytest

from memloom.operators import messages, scan


def plain(rows, most):
    groups, out = defaultdict(list), []
    for g, o, i, a, b in rows:
        groups[g].append((o, i, a, b))
    for g, own in groups.items():
        total = 0
        for _, i, a, b in sorted(own, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
            pick = next((x for x in (a, b) if x is not None and total + len(x) <= most), None)
            if pick is None:
                break
            total += len(pick)
            out.append((g, i, pick, total))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "block", "most"), [(0, 20_000, 60), (1, 7, 60), (2, 3, 25), (3, 5, 0)])
def test_budget_is_the_loop(spark, seed, block, most, monkeypatch):
    """One session holds half of all turns; some texts are empty or null, some rows are equal."""
    monkeypatch.setattr(scan, "BLOCK", block)
    r = random.Random(seed)
    rows = []
    for k in range(160):
        a = r.choice([None, "", "", "x" * r.randint(1, 40)])
        rows.append((r.choice(["hot", "hot", "hot", f"s{k % 9}", None]), r.randrange(50), k if r.random() < 0.8 else 5, a, r.choice([None, "", (a or "")[:3], (a or "")[:9]])))
    rows += rows[:6]
    df = spark.createDataFrame(rows, "g string, o int, id long, a string, b string").repartition(3)
    got = scan.budget(df, most, scan.F.col("o"), scan.F.col("a"), scan.F.col("b"), "g")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, most)
    assert scan.budget(df.where("false"), most, scan.F.col("o"), scan.F.col("a"), scan.F.col("b"), "g").count() == 0


def test_long_sessions_are_cut_into_stretches(spark):
    r = random.Random(4)
    rows = [("long" if r.random() < 0.6 else f"s{k % 5}", k // 2 * 7, r.choice(["user", "user", "assistant", "system"]), f"text {k} of the session") for k in range(3000)]
    df = spark.createDataFrame(rows, "session_id string, turn long, role string, content string").repartition(4)
    got = {(x.session_id, x.block): (x.text, x.messages) for x in messages.blocks(df, 500, 1).collect()}
    want = defaultdict(list)
    for s, t, role, c in rows:
        if role != "system":
            n = sum(1 for s2, t2, r2, _ in rows if s2 == s and t2 < t and r2 == "assistant") if s != "long" else None
            want[s, n].append((t, f"{role}: {c}"))
    long = defaultdict(list)
    turns = sorted({t for s, t, _, _ in rows if s == "long"})
    seen = {}
    n = 0
    for t in turns:
        seen[t] = n
        n += sum(1 for s2, t2, r2, _ in rows if s2 == "long" and t2 == t and r2 == "assistant")
    for t, line in want.pop(("long", None)):
        long["long", seen[t]].append((t, line))
    want |= long
    assert got == {k: ("\n".join(x for _, x in sorted(v)), len(v)) for k, v in want.items()}
