"""Suffix-array dedup against brute force."""

import hashlib
import random

import duckdb
import pytest

from memloom.llm import suffix_dedup


def brute(rows, span=suffix_dedup.SPAN):
    """By a table of every window's smallest id."""
    least = {}
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            least[w] = min(i, least.get(w, i))
    out = []
    for (i, b), (own, _) in zip(data, rows, strict=True):
        cut = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if least[b[s : s + span]] < i:
                cut[s : s + span] = b"\1" * span
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(1 for k in range(len(b)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((own, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéñ") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(6, 40))) for _ in range(8)]
    out = []
    for i in range(120):
        kind = r.random()
        if kind < 0.1:
            out.append(r.choice([None, "", "x" * r.randint(0, 400), "ab" * r.randint(1, 300), "\x00" * r.randint(1, 120)]))
        elif kind < 0.2 and out:
            out.append(r.choice(out))
        else:
            out.append(" ".join(r.choice([word(), word(), r.choice(passages), r.choice(passages)[r.randint(0, 20) :]]) for _ in range(r.randint(1, 20))))
    ids = [r.choice([i, i, i, max(0, i - 1), None]) if r.random() < 0.2 else i for i in range(len(out))]
    r.shuffle(ids)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_digest_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int").repartition(3)
    assert sorted(map(tuple, suffix_dedup.digest(df).collect()), key=repr) == brute(rows)


def test_dedup_keeps_columns(spark):
    a = "The quick brown fox jumps over the lazy dog and runs far away from here. "
    df = spark.createDataFrame([(1, "x " + a, "p", 7), (2, a + "tail", None, 8), (3, None, "q", 9)], "doc_id long, text string, source string, n_removed int")
    got = {r.doc_id: r for r in suffix_dedup.dedup(df).collect()}
    assert got[1].text == "x " + a and got[2].text == "tail" and got[3].text is None
    assert [got[k].n_removed for k in (1, 2, 3)] == [0, len(a), 0] and got[3].source == "q"
    assert suffix_dedup.dedup(df.where("false")).count() == 0 == suffix_dedup.digest(df.where("false")).count()


def test_whole_table(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, suffix_dedup.digest(df).collect()), key=repr) == brute(rows)


def brute_components(rows, words, num, den):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("seed", "words", "num"), [(0, 4, 85), (1, 5, 80), (2, 2, 50)])
def test_links_are_brute_force(spark, seed, words, num, monkeypatch):
    from memloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CHUNK", 20_000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    r = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three four", "É É", "é é"]
    for _ in range(25):
        base = [f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 90))]
        for _ in range(r.randint(1, 12)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = f"w{r.randint(0, 60)}"
            texts.append(" ".join(t))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    want = brute_components(rows, words, num, 100)
    assert sorted(map(tuple, jaccard_join.linked(df, words, num, 100).collect())) == want
    assert len({c for _, _, c in want}) < len(want)
    kept = jaccard_join.one_of_each(df.unionByName(df.where("doc_id = 1")), words, num, 100)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in want}) and kept.columns == df.columns


def test_links_of_odd_tables(spark):
    from memloom.llm import jaccard_join

    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, None), (7, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.linked(df).collect()), key=repr) == [(7, 0, 7), (7, 0, 7), (None, 1, None), (None, 1, None)]
    assert jaccard_join.linked(df.where("false")).count() == 0
    assert jaccard_join.one_of_each(df).count() == 2


def test_chains_of_passages_are_no_links(spark, monkeypatch):
    """Each text shares a passage with the next, so that all lie in one cluster; only planted copies link."""
    from memloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r = random.Random(4)
    passage = [[f"p{k}w{j}" for j in range(40)] for k in range(301)]
    texts = [" ".join(passage[k] + passage[k + 1] + [f"own{k}"] * (k % 3)) for k in range(300)]
    texts += [t + " more" for t in r.sample(texts, 40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, 5, 80, 100)
    assert sorted(map(tuple, jaccard_join.linked(df).collect())) == want and len({c for _, _, c in want}) == 300


def test_sets_with_one_hash_are_told_apart(spark):
    from memloom.llm import jaccard_join

    rows = [(1, 10, 5, 3), (2, 10, 6, 3), (3, 10, 5, 3), (4, 11, 5, 2), (5, 10, 7, 0)]
    got = {x.doc_id: x.node for x in jaccard_join._told_apart(spark.createDataFrame(rows, "doc_id long, node long, more long, n long")).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3 and got[4] == 11
    alone = jaccard_join._told_apart(spark.createDataFrame(rows[:1], "doc_id long, node long, more long, n long"))
    assert alone.columns == ["doc_id", "node", "n"] and alone.first().node == 10
