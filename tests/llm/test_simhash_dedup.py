"""SimHash fingerprints and links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from memloom.llm import simhash_dedup as sd


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=repr)


def scattered(seed, n):
    """Fingerprints in clusters of a few flips, chains, and a hot bucket."""
    r = random.Random(seed)
    out = [0, (1 << 64) - 1, 7, 15, 31]
    while len(out) < n:
        kind = r.random()
        x = r.getrandbits(64)
        if kind < 0.3:
            x = 0xABCD << 48 | r.getrandbits(48)
        elif kind < 0.8:
            x = r.choice(out)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("seed", "blocks", "tile"), [(0, None, 8192), (1, 4, 30), (2, 5, 8192), (3, 6, 8), (4, 4, 100)])
def test_components_of_links_are_brute_force(spark, seed, blocks, tile, monkeypatch):
    monkeypatch.setattr(sd, "TILE", tile)
    monkeypatch.setattr(sd, "SLAB", 500)
    monkeypatch.setattr(sd, "PAIRS", 2000)
    fps = scattered(seed, 900)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    found = sd.links(df, blocks).collect()
    for r in found:
        assert r.a != r.b
    own = {f: f for f in fps}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for r in found:
        a, b = (find(int(np.int64(x).view(np.uint64))) for x in (r.a, r.b))
        own[max(a, b)] = min(a, b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), []).append(f)
    want = {}
    for f, (_, _, c) in zip(fps, sorted(brute_components(list(zip(fps, fps, strict=True))), key=lambda x: x[0]), strict=True):
        want.setdefault(c, []).append(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abÉé字Z") for _ in range(r.randint(1, 9)))
    out = [None, "", " \t\n", "One", "one two", "ONE  two", "one two three", "ÉÉ éé"]
    for _ in range(140):
        kind = r.random()
        if kind < 0.4 and len(out) > 10:
            w = (r.choice(out[8:]) or "x").split()
            w[r.randrange(len(w))] = word()
            out.append(r.choice([" ", "  ", "\n"]).join(w))
        elif kind < 0.5:
            out.append(r.choice(out))
        else:
            out.append(" ".join(word() for _ in range(r.randint(1, 400))))
    ids = [r.choice([k, k, k, None, max(0, k - 1)]) for k in range(len(out))]
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("seed", "piece"), [(0, 1 << 20), (1, 40)])
def test_documents_are_brute_force(spark, seed, piece, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", piece)
    rows = texts(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, root int").repartition(3)
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    assert sorted(map(tuple, sd.linked(df).collect()), key=repr) == want


def test_hash_is_the_one_of_spark(spark):
    from pyspark.sql import functions as F

    said = ["", "a", "one two three", "é" * 50]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r[0] for r in df.select(F.xxhash64("s")).collect()] == [int(np.uint64(xxhash.xxh64_intdigest(s.encode(), sd.SEED)).view(np.int64)) for s in said]


def test_empty_table_and_copies_alone(spark):
    df = spark.createDataFrame([(5, "a b c d"), (3, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sd.linked(df.where("false")).count() == 0
    assert {r.component_id for r in sd.linked(df).collect()} == {3} and sd.linked(df).count() == 3


def test_layouts_cover_every_pair():
    for blocks in (4, 5, 7):
        for fields, lead in sd.layouts(blocks):
            x = np.array([0x0123456789ABCDEF, 2**63, 1], np.uint64)
            assert (sd.unlaid(sd.laid(x, fields), fields) == x).all() and lead >= 64 * (blocks - 3) // blocks - 1
    assert sd.blocks_for(10) == 4 and sd.blocks_for(10**10) == 5
    ranks = np.arange(1 << 12, dtype=np.uint64)
    assert (sd.gray_rank(sd.gray_code(ranks)) == ranks).all()
