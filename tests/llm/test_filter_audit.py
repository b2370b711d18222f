"""The audit of filters against brute force over documents, orders and steps."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import filter_audit, words


def mask_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))
    return sum(t << k for k, t in enumerate(tests))


def brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    cells = Counter()
    for i, t, s in docs:
        m = mask_of(t or "") | (16 if i is not None and i > least[t or ""] else 0)
        mine = [x for x in labels if i is not None and x[0] == i]
        cells[s or "", m, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)] += 1
    out = []
    for part in {k[0] for k in cells}:
        own = [(m, g, t, n) for (p, m, g, t), n in cells.items() if p == part]
        rows = []
        for o in permutations("ABCDE"):
            left = own
            for step, x in enumerate(o, 1):
                bit = 1 << "ABCDE".index(x)
                gone, kept = [r for r in left if r[0] & bit], [r for r in left if not r[0] & bit]
                late = [r for r in own if r[0] & bit and r not in left]
                total = lambda rs: sum(r[3] for r in rs)
                rows.append((part, "".join(o), step, total(kept), total(gone), total(late), total(r for r in own if r[0] == bit), total(r for r in gone if r[1]), total(r for r in gone if r[2]), x))
                left = kept
        share = Counter()
        for r in rows:
            share[r[-1]] += r[4]
        out += [(*r[:-1], share[r[-1]]) for r in rows]
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉé字Zq#") for _ in range(r.randint(1, 20)))
    few = [word() for _ in range(30)]
    docs = []
    for i in range(150):
        t = r.choice([None, "", " \n\t", "A", "x" * 3000, " ".join(word() for _ in range(r.randint(45, 90))), r.choice("\n ").join(r.choice(few) for _ in range(r.randint(40, 200))), docs[-1][1] if docs else "a"])
        docs.append((r.choice([i, i, i, None, max(0, i - 1)]), t, r.choice(["s", "s", "s", "", None, "t"])))
    labels = [(r.choice([None, k]), r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 160, 2) for _ in range(r.randint(1, 2))]
    return docs, labels


@pytest.mark.parametrize(("seed", "piece"), [(0, 2_000_000), (1, 400), (2, 64)])
def test_audit_is_brute_force(spark, seed, piece, monkeypatch):
    docs, labels = made(seed)
    monkeypatch.setattr(filter_audit, "SLICE", piece)
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, n int, mask int").repartition(3)
    lab = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, bad int")
    assert sorted(map(tuple, filter_audit.audit(d, lab).collect())) == brute(docs, labels)


def test_empty_tables_and_missing_labels(spark):
    d = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d.where("false"), lab).count() == 0
    assert sorted(map(tuple, filter_audit.audit(d, lab).collect())) == brute([(1, "a b", "s")], [])


def test_copies_of_one_text_meet_in_no_task(spark):
    """A third of the table repeats a text: the smallest id alone stays, whatever the part."""
    d = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('t', id) END AS text", "concat('s', id % 2) AS source")
    lab = spark.createDataFrame([(0, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.step): r for r in filter_audit.audit(d, lab).where("filter_order = 'EABCD'").collect()}
    assert (got["s0", 1].removed, got["s1", 1].removed) == (499, 500) and (got["s1", 1].good_lost, got["s1", 1].toxic_lost, got["s0", 1].good_lost) == (1, 1, 0)


def test_words_of_equal_hash_are_told_apart():
    data, offsets = words.buffer_of(pa.array(["aa bb aa", None, "bb cc bb"]))
    found = words.find_words(data[:-8] == 32, offsets)
    group = np.array([0, 0, 0, 2, 2, 2])
    for h in (words.word_hash(data, found), np.zeros(6, np.uint64)):
        first, number = words.distinct_within(data, found, group, h)
        assert len(first) == 4 and (number[0] == number[2]) and (number[3] == number[5]) and len(set(number.tolist())) == 4
