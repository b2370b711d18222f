"""Range coder round trips, and token files against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import range_coder, token_files
from memloom.llm.common import scratch, tokenizer_path
from tests.llm.test_tokens import odd_texts

PATH = tokenizer_path("byte_bpe_50k.json")


def through(spark, blocks, bits=20):
    """Each block's ids coded, two at a time and the last or a shorter one by itself, and the code."""
    raw = [bytearray(np.asarray(b).astype(range_coder.kind(bits)).tobytes()) for b in blocks]
    pairs, k = [], 0
    while k < len(blocks):
        two = k + 1 < len(blocks) and len(blocks[k]) >= len(blocks[k + 1]) > 0
        pairs.append((k, raw[k], len(blocks[k]), raw[k + 1] if two else None, len(blocks[k + 1]) if two else 0))
        k += 1 + two
    df = spark.createDataFrame(pairs, "i int, a binary, n int, b binary, m int")
    df = df.withColumn("c", range_coder.coded(spark, *map(F.col, "anbm"), F.lit(bits)))
    rows = df.orderBy("i").collect()
    parts = [range_coder.apart(bytes(r.c))[: 1 + (r.b is not None)] for r in rows]
    back = spark.createDataFrame([(r.i, bytearray(p[0]), r.n, bytearray(p[1]) if p[1:] else None, r.m) for r, p in zip(rows, parts, strict=True)], "i int, a binary, n int, b binary, m int")
    back = back.withColumn("d", range_coder.decoded(spark, *map(F.col, "anbm"), F.lit(bits))).orderBy("i").collect()
    assert [bytes(r.d)[4:] for r in back] == [bytes(r.a) + bytes(r.b or b"") for r in rows]
    return [x for p in parts for x in p]


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 20])
def test_coder_round_trip(spark, top):
    blocks = []
    for n in (0, 1, 2, 7, 4095, 32768, 40000):
        r = np.random.default_rng(n + top)
        blocks += [r.integers(0, top, n), np.minimum(r.zipf(1.2, n) - 1, top - 1) if n else [], np.tile(r.integers(0, top, 7), n // 7 + 1)[:n], np.zeros(n, int), np.full(n, top - 1)]
    through(spark, blocks)
    through(spark, blocks, range_coder.bits_of(top))


def test_sure_models_can_be_wrong(spark):
    """Order 2 is always right and order 1 always wrong, then the other way round."""
    r = np.random.default_rng(0)
    blocks = []
    for _ in range(20):
        a, b, c = r.integers(0, 50257, 3)
        blocks.append(np.concatenate([np.tile([a, b, a, c], 700), np.tile([a, b], 300), r.integers(0, 3, 400), np.tile([a, c, b], 100)]))
    through(spark, blocks)


def test_coder_learns(spark):
    ids = np.tile(np.arange(50) * 900, 2000)
    assert len(through(spark, [ids])[0]) < len(ids) / 50
    skewed = np.random.default_rng(0).choice(50257, 32768, p=1 / np.arange(1, 50258) / (1 / np.arange(1, 50258)).sum())
    p = np.bincount(skewed) / len(skewed)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert 8 * len(through(spark, [skewed], 16)[0]) / len(skewed) < 1.35 * entropy  # new ids cost more than the counts of the whole tell
    assert 8 * len(through(spark, [np.random.default_rng(0).integers(0, 1 << 16, 32768)], 16)[0]) / 32768 < 17.5


def test_ids_out_of_range_raise(spark):
    with pytest.raises(Exception, match="more than 12 bits"):
        through(spark, [[1 << 12]], 12)
    with pytest.raises(Exception, match="more than 18 bits"):
        through(spark, [[1 << 18]], 18)
    with pytest.raises(Exception, match="1 to 20 bits"):
        through(spark, [[1]], 21)


def test_blocks_are_independent(spark):
    ids = np.random.default_rng(1).integers(0, 5000, (3, range_coder.BLOCK))
    assert through(spark, [*ids]) == [through(spark, [x])[0] for x in ids]


def test_damage_is_found():
    index = token_files.index_bytes([1, None], np.array([3, 2]))
    data = bytearray(token_files.file_bytes(index, 5, 16, [b"block"]))
    h, got, blocks = token_files.read_file(bytes(data))
    ids, counts = token_files.read_index(got)
    assert (h["ids"], h["bits"], ids, counts.tolist(), blocks) == (5, 16, [1, None], [3, 2], [b"block"])
    for at in (-1, len(data) - 20):
        data[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_files.read_file(bytes(data))
        data[at] ^= 1


def test_long_texts(spark, monkeypatch):
    """A text of many blocks between short ones."""
    monkeypatch.setattr(range_coder, "BLOCK", 1000)
    texts = ["a b", "".join(random.Random(1).choices("abcdefgh  ", k=200_000)), "", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = Tokenizer.from_file(PATH)
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    manifest = token_files.write_tokens(df, PATH, scratch(spark, "t"))
    assert {r.doc_id: r.ids for r in token_files.tokens_of(manifest).collect()} == want


def test_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 9000)
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    texts = odd_texts()
    ids = [i * 3 % 101 - 50 if i != 9 else None for i in range(len(texts))]  # some ids repeat
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int").repartition(3)
    lib = Tokenizer.from_file(PATH)
    code = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    manifest = token_files.write_tokens(df, PATH, scratch(spark, "t"))
    assert manifest.count() > 3
    assert sorted((r.doc_id, r.ids) for r in token_files.tokens_of(manifest).collect() if r.doc_id is not None) == sorted((i, code(t)) for i, t in zip(ids, texts, strict=True) if i is not None)
    got = sorted(map(tuple, token_files.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    crc = lambda t: zlib.crc32(np.array(code(t), "<u4").tobytes())
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((i, len(code(t)), crc(t)) for i, t in zip(ids, texts, strict=True) if i is not None)
    assert token_files.round_trip(df.where("false"), PATH).count() == 0
