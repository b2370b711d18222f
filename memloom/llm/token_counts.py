"""Token counts without token ids.

A text's tokens are counted from its pre-tokens: the kernel (java/Split.java) cuts each text where it is read, every distinct pre-token of the
corpus is given its piece count once, and a document's count is the sum of frequency times pieces.

1. Each task gathers its documents in blocks and keeps, for each distinct pre-token of the block, in which documents it
   stands and how often: postings, dealt to buckets by the pre-token's hash. Buckets grow with the square root of the input, as its
   vocabulary does. A frequent pre-token is one entry of a block,
   so no key gets more than a row from each block.
2. A bucket's task counts the pieces of a pre-token when it first meets it (again only past KNOWN of them) and sums its postings to one number for each
   document of the block.
3. The numbers of a block come together and are added up.

Null text: empty, 0 tokens. Every input row gives one row, repeated ones too. Special strings inside a text are cut out first
and count as one token, as the library does by default. Null doc_id: kept. Extra columns are ignored. Empty table: no rows. Rows are
matched by their place in a block, so docs should be a table, whose tasks give the same rows in the same order when they run again; other
input is noticed and raises.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm import kernels, splitter
from memloom.llm.bpe_automaton import byte_symbols
from memloom.llm.common import batches, lean, partitions, plan_bytes, slices, small_batches

#: Bytes of text in one block.
BLOCK = 12_000_000
LIMIT = 1024
#: Pre-tokens whose counts a bucket's task keeps.
KNOWN = 2_000_000

_SCHEMA = "bucket int, block string, kind int, rows long, words binary, counts binary, docs binary, freqs binary"
_PIECES: dict[str, "Pieces"] = {}


class _Token(NamedTuple):
    id: int


class Pieces:
    """A byte-level BPE file: its special strings, and the pieces of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("a tokenizer of this kind is not covered")
        self.special = {x["content"] for x in spec["added_tokens"]}
        pre["use_regex"] = False  # a pre-token isn't split again
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.special_ids = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        #: what stands for each byte in the vocabulary, and a mark between words
        self.signs = np.array([ord(c) for c in byte_symbols()[:255]] + [0], "<u4")

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pre-tokens (in UTF-8) end to end, and how many each has."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        said = self.signs[np.frombuffer(b"\xff".join(words), "u1")].tobytes().decode("utf-32-le").split("\0")
        found = list(map(self.library.model.tokenize, said))
        if not self.special_ids.keys().isdisjoint(words):
            for k, w in enumerate(words):
                if w in self.special_ids:
                    found[k] = [_Token(self.special_ids[w])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t.id for x in found for t in x), "<u4", int(sizes.sum())), sizes

    def count(self, words: list[bytes]) -> list[int]:
        return self.ids(words)[1].tolist()


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _block(key: str, cuts: list[bytes], sizes: np.ndarray, ids: pa.Array, buckets: int) -> Iterator[tuple]:
    """Rows of one block: its documents (kind 1), and the postings of each bucket (kind 0)."""
    words: list[bytes] = []
    freqs = [np.zeros(0, np.int64)]
    per_doc = np.zeros(len(cuts), np.int64)
    for i, c in enumerate(cuts):
        _, own, places = splitter.unpacked(c)
        words += own
        freqs.append(np.bincount(places, minlength=len(own)))
        per_doc[i] = len(own)
    known = np.asarray(ids.is_valid())
    yield zlib.crc32(key.encode()) % buckets, key, 1, len(cuts), np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), known.astype("u1").tobytes(), sizes.astype("<i8").tobytes(), b""
    vocab = list(dict.fromkeys(words))
    at = dict(zip(vocab, range(len(vocab)), strict=True))
    home = np.fromiter(map(zlib.crc32, vocab), np.int64, len(vocab)) % buckets
    rank = np.empty(len(vocab), np.int64)
    by_home = np.argsort(home, kind="stable")
    rank[by_home] = np.arange(len(vocab))
    post = rank[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
    order = np.argsort(post, kind="stable")
    docs = np.repeat(np.arange(len(cuts)), per_doc)[order].astype("<u4")
    freq = np.concatenate(freqs).astype("<u4")[order]
    counts = np.bincount(post, minlength=len(vocab)).astype("<u4")
    word_ends = np.searchsorted(home[by_home], np.arange(buckets + 1))
    post_ends = np.r_[0, np.cumsum(counts)][word_ends]
    for b in range(buckets):
        w0, w1 = word_ends[b : b + 2]
        if w1 > w0:
            p0, p1 = post_ends[b : b + 2]
            # bytes 0xFF never stand in UTF-8
            yield b, key, 0, w1 - w0, b"\xff".join([vocab[k] for k in by_home[w0:w1]]), counts[w0:w1].tobytes(), docs[p0:p1].tobytes(), _narrow(freq[p0:p1])


def _narrow(x: np.ndarray) -> bytes:
    """One byte each where all fit, else four; the reader tells by the length."""
    return x.astype("u1").tobytes() if x.max(initial=0) < 256 else x.astype("<u4").tobytes()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs, for the byte-level BPE file at `path`."""
    spark = docs.sparkSession
    width = partitions(spark)
    small_batches(spark)
    buckets = buckets or max(2 * width, math.isqrt(plan_bytes(docs) // 1_000_000))

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, part = 0, TaskContext.get().partitionId()
        for t in batches(rows, BLOCK):
            cuts, ids, sizes = t.column("cut").to_pylist(), t.column("doc_id").cast(pa.int64()).combine_chunks(), np.asarray(t.column("n_bytes"))
            for a, b in slices(sizes, BLOCK):
                own = ids[a:b]
                key = f"{part}-{k}-{zlib.crc32(repr(own.to_pylist()).encode()):08x}-{b - a}"
                k += 1
                yield _table(list(_block(key, cuts[a:b], sizes[a:b], own, buckets)))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = pieces(path), {}
        for batch in rows:
            out = []
            for r in batch.to_pylist():
                if r["kind"]:
                    out.append(tuple(r.values()))
                    continue
                words = r["words"].split(b"\xff")
                if len(known) > KNOWN:
                    known.clear()
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, cut.count(fresh), strict=True))
                n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                at = np.frombuffer(r["docs"], "<u4")
                freq = np.frombuffer(r["freqs"], "u1" if len(r["freqs"]) == len(at) else "<u4")
                sums = np.bincount(at, np.repeat(n, np.frombuffer(r["counts"], "<u4")) * freq)
                own = np.flatnonzero(sums)
                out.append((r["bucket"], r["block"], 0, 0, b"", b"", own.astype("<u4").tobytes(), sums[own].astype("<u4").tobytes()))
            yield _table(out)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the block's documents before its sums."""
        block, ids, valid, sizes, sums = None, None, None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~valid), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(sums > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in rows:
            for r in batch.to_pylist():
                if r["kind"]:
                    if block is not None:
                        yield done()
                    block, ids, valid, sizes = r["block"], np.frombuffer(r["words"], "<i8"), np.frombuffer(r["counts"], "u1").astype(bool), np.frombuffer(r["docs"], "<i8")
                    sums = np.zeros(len(ids), np.int64)
                elif r["block"] != block:
                    raise RuntimeError("the rows of a block changed between attempts of a task; give docs a fixed row order")
                else:
                    sums[np.frombuffer(r["docs"], "<u4")] += np.frombuffer(r["freqs"], "<u4")
        if block is not None:
            yield done()

    text = F.col("text").cast("string")
    cut = kernels.split(spark, text, splitter.packed(), sorted(pieces(path).special))
    parts = docs.select("doc_id", F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), cut.alias("cut")).mapInArrow(lean(split), _SCHEMA).repartition(width, "bucket")
    sums = parts.mapInArrow(lean(count), _SCHEMA).repartition(width, "block").sortWithinPartitions("block", F.desc("kind"))
    return sums.mapInArrow(lean(add), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
