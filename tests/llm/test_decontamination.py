"""Decontamination against brute force over every window."""

import collections
import random
import re

import numpy as np

from memloom.llm import decontamination as dc


def words_of(t):
    return [w for w in (re.sub(r"\W+", "", x.decode().lower()) for x in (t or "").encode().split()) if w]


def bag(words, k):
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items, similarity=0.8):
    out = []
    for d, t in docs:
        w = words_of(t)
        for i, it in items:
            own = words_of(it)
            if not own or not w:
                continue
            k = min(5, len(own), len(w)) if len(own) < 5 or len(w) < 5 else 5
            if len(own) >= 5 > len(w):
                continue
            k = min(5, len(own))
            if len(w) < k:
                continue
            b, size = bag(own, k), min(len(own), len(w))
            best = None
            for s in range(len(w) - size + 1):
                c = bag(w[s : s + size], k)
                low = sum((b & c).values())
                v = low / (sum(b.values()) + sum(c.values()) - low)
                if v >= similarity and (best is None or v > best[0]):
                    best = (v, s)
            if best:
                out.append((d, i, round(best[0], 6), best[1]))
    return sorted(out, key=repr)


def test_pairs_are_brute_force(spark):
    r = random.Random(2)
    word = lambda: r.choice(["Alpha", "beta,", "été", "x1", "der"]) if r.random() < 0.1 else "w" + str(r.randint(0, 4000))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 8, 20, 20, 45, 60])))) for i in range(40)] + [(90, None), (91, ""), (92, "... !"), (93, "the same the same the same the same the same the same")]
    docs = []
    for i in range(120):
        t = [word() for _ in range(r.choice([0, 3, 30, 200]))]
        for _ in range(r.randint(0, 2)):
            own = (r.choice(items)[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if own:
                    own[r.randrange(len(own))] = word().upper()
            at = r.randint(0, len(t))
            t[at:at] = [x.upper() + r.choice(["", ".", "!"]) for x in own]
        docs.append((i, " ".join(t)))
    docs += [(500, None), (501, ""), (502, "w1"), (503, "x " * 50_000), docs[5]]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, dc.find_contaminated(df, bench).collect()), key=repr)
    want = brute(docs, items)
    assert got == want and len(want) > 40
    bad = {d for d, *_ in want}
    assert sorted(x.doc_id for x in dc.decontaminate(df, bench).collect()) == sorted(d for d, _ in docs if d not in bad)  # ids with one text each


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    items = [(i, " ".join(f"a{i} b{i} c{k}" for k in range(4))) for i in range(12)]
    df = spark.createDataFrame([(i, "Start " + t + " end") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.find_contaminated(df, bench).collect()) == [(i, i) for i in range(12)]
    assert dc.find_contaminated(df.where("false"), bench).count() == 0 == dc.find_contaminated(df, bench.where("false")).count()


def flipped(r, prints, most):
    """Prints with a random number of their bits turned over."""
    out = prints.copy()
    for k in range(len(out)):
        for b in r.choice(dc.BITS, r.integers(0, most), replace=False):
            out[k, b // 16] ^= np.uint16(1 << (b % 16))
    return out


def test_multi_index_misses_none():
    r = np.random.default_rng(1)
    items = [(k, r.integers(0, 2**63, 30, dtype=np.int64).astype(np.uint64)) for k in range(200)]
    index = dc.SizeIndex(items, dc.RADIUS)
    prints = flipped(r, index.prints, 50)
    want = [w * 200 + k for w in range(200) for k in range(200) if np.bitwise_count(prints[w] ^ index.prints[k]).sum() <= dc.RADIUS]
    assert index.candidates(prints).tolist() == want and 100 < len(want) < 190


def test_fingerprints_alone_find_nearly_all(spark):
    """Items of 20 to 100 words with a similarity of .80 to .85: the index without the exact rest, and what the rest adds."""
    r = random.Random(11)
    word = lambda: "w" + str(r.randint(0, 5000))
    items = [(i, " ".join(word() for _ in range(r.choice([40, 50, 60, 80, 100])))) for i in range(200)]
    docs = []
    for i, t in items:
        for k in range(4):
            own = t.split()
            for _ in range(r.choice([1, 1, 2])):
                own[r.choice([0, 1, 2, len(own) - 1, len(own) - 2, len(own) - 3, r.randrange(len(own))])] = word()
            docs.append((1000 * i + k, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    whole = {(x.doc_id, x.item_id): x.similarity for x in dc.find_contaminated(df, bench).collect()}
    alone = {(x.doc_id, x.item_id) for x in dc.find_contaminated(df, bench, rest=False).collect()}
    hard = {k for k, v in whole.items() if v <= 0.85}
    assert len(hard) > 60 and alone <= set(whole)
    print(f"fingerprints alone: {len(alone)} of {len(whole)}, {len(hard & alone)} of {len(hard)} at .80 to .85")
    assert len(alone) >= 0.99 * len(whole) and len(hard & alone) >= 0.98 * len(hard)


def test_no_window_is_lost_near_the_threshold(spark):
    """Items of 20 to 100 words with as many words changed as a similarity of .80 to .85 allows, runs of one shingle, and prose around them."""
    r = random.Random(9)
    word = lambda: "w" + str(r.randint(0, 3000))
    items = [(i, " ".join(word() for _ in range(r.choice([20, 50, 60, 100])))) for i in range(70)]
    items += [(200 + i, " ".join([word() for _ in range(60)] + ["na"] * 14)) for i in range(20)]
    docs = []
    for i, t in items:
        for k in range(3):
            own = t.split()
            for _ in range(r.choice([1, 1, 2])):  # changes at the ends cost the fewest shingles
                at = r.choice([0, 1, 2, len(own) - 1, len(own) - 2, len(own) - 3, r.randrange(len(own))])
                own[at] = word()
            docs.append((1000 * i + k, " ".join([word() for _ in range(r.randint(0, 40))] + own + [word() for _ in range(r.randint(0, 40))])))
    want = brute(docs, items)
    near = sum(0.8 <= v <= 0.85 for _, _, v, _ in want)
    got = dc.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == want and near > 12


def test_the_index_looks_at_few_items():
    r = np.random.default_rng(3)
    index = dc.SizeIndex([(k, r.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)) for k in range(3000)], dc.RADIUS)
    prints = dc.fingerprints(r.normal(size=(500, dc.BITS)))
    assert len(index.looked_at(prints)) < 0.1 * 500 * 3000


def test_long_texts_take_bounded_memory():
    """Hits at both ends of a long text, and shingles of the item all along it."""
    import tracemalloc

    item = " ".join(f"i{k}" for k in range(60))
    bench = dc.Benchmark([(1, item)], dc.RADIUS, dc.SIMILARITY)
    text = " ".join([item, *(f"x{k % 5000} i1 i2 i3 i4 i5" for k in range(100_000)), item])
    tracemalloc.start()
    got = list(dc._held(bench, [text]))
    assert [(k, v, f) for k, _, v, f in got] == [(0, 1.0, 0)] and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"a{k}" for k in range(12))
    rows = [(None, item), (None, "clean prose here"), (1, item), (1, "other clean prose"), (2, None), (2, None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, similarity int")
    bench = spark.createDataFrame([(5, item), (None, item)], "item_id long, text string")
    assert sorted(map(tuple, dc.decontaminate(df, bench).collect()), key=repr) == sorted([(None, "clean prose here", 7), (1, "other clean prose", 7), (2, None, 7), (2, None, 7)], key=repr)
    assert {(x.doc_id, x.item_id) for x in dc.find_contaminated(df, bench).collect()} == {(None, 5), (None, None), (1, 5), (1, None)}
