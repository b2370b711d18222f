"""Removal of repeated passages by prefix-free parsing.

Every SPAN-byte string that also starts in a document with a smaller id is cut out of the later documents.

A polynomial rolling hash over TRIGGER bytes picks, in each SPAN-byte window, the trigger of the smallest hash (the leftmost one
on ties). The choice depends on the window's bytes alone, so equal windows have equal triggers at equal offsets. Neighbouring
windows that share a trigger are cut at it into two phrases that overlap in the trigger, as in prefix-free parsing: what stands
before it, and what starts with it. A corpus suffix that starts in a left phrase is ordered by that phrase's rest, a suffix of
the dictionary, and then by the rank of the right phrase in the parse. So the order of all such suffixes follows from
the sorted suffixes of distinct left phrases and the sorted distinct right phrases, and the longest common prefixes of
neighbours in both orders tell which windows are equal. Copies of a passage are one pair of phrases, however many there are.

Passes, each over chunks of documents that are written to the shared folder once and read by name:

1. A window has HALF bytes more before its trigger, or else HALF more behind it; the trigger with these bytes is its anchor, and each
   run of windows falls into two by this. Chunks send their distinct anchors (32 bits of hash in a fragment of the hash range); fragments
   answer with one bit each: does the anchor stand in more than one document? A collision costs work only.
2. Chunks parse again, and send the distinct pairs of phrases at repeated anchors, with the smallest id that has them, to the
   anchor's bucket. Buckets order them and answer with each window's smallest id in the corpus.
3. Chunks parse a third time, compare these ids with their own and cut.

No text is shuffled, no group of copies is gathered, and work grows with the input. Chunks hold CHUNK bytes or one document.

Null text: empty. Null doc_id: greater than any id. Rows with equal ids don't cut each other. Texts shorter than SPAN bytes are
left alone. Other columns are carried along by `dedup`; a `text` cut within a character loses that character's rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm.chunks import CHUNK, chunked, distinct_rows, groups, packed, part_of, read_chunk, row_batch, sorted_rows, steps, unpacked
from memloom.llm.common import by_parts, crc, lean, partitions, scratch, small_batches

SPAN = 50
TRIGGER = 16
WINDOW = SPAN - TRIGGER + 1
LEFT = WINDOW - 1
HALF = TRIGGER
#: Windows parsed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LAST = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 28) - 1)
_ROW = LEFT + SPAN + 2

_ANCHORS = "frag int, chunk string, n int, low binary, many binary"
_ANSWERS = "frag int, chunk string, n int, bits binary"
_PAIRS = "bucket int, chunk string, kind int, pairs binary, ids binary"


def rolling(b: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER bytes at each offset: the Karp-Rabin polynomial modulo 2^64, built by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < TRIGGER:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the polynomial's value over all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Parse:
    """Every half run of windows of a buffer of texts: first and last window, the trigger's offset, the anchor's hash, the text's number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        ends = np.unique(offsets[1:])
        cross = np.zeros(len(data) + 1, np.int8)
        low, at = np.unique(np.maximum(ends - SPAN + 1, 0), return_counts=True)
        cross[low] += at.astype(np.int8)
        cross[ends] -= 1
        inside = np.cumsum(cross[:-1], dtype=np.int8) == 0
        got = [self._piece(data[a : a + PIECE + SPAN - 1], a, inside) for a in range(0, max(0, len(data) - SPAN + 1), PIECE)]
        self.first, self.last, self.at, self.hash = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint64 if k == 3 else np.int64) for k in range(4))
        self.text = np.searchsorted(offsets, self.at, "right") - 1

    @staticmethod
    def _piece(b: np.ndarray, base: int, inside: np.ndarray) -> tuple[np.ndarray, ...]:
        h = rolling(b)
        m = (mixed(h) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            m, width = np.minimum(m[:-width], m[width:]), 2 * width
        if width < WINDOW:
            m = np.minimum(m[: width - WINDOW], m[WINDOW - width :])
        v = np.flatnonzero(inside[base : base + len(m)])
        at = (m[v] & _LOW).astype(np.int64)
        new = np.ones(len(v) + 1, bool)
        new[1:-1] = (at[1:] != at[:-1]) | (v[1:] != v[:-1] + 1)
        new = new if len(v) else np.zeros(1, bool)
        at, first, last = at[new[:-1]], v[new[:-1]], v[new[1:]]
        # windows that start HALF bytes or more before the trigger, and the others
        far, near = at - first >= HALF, at - last < HALF
        at2 = np.r_[at[far], at[near]]
        anchor = np.r_[at[far] - HALF, at[near]]
        first2, last2 = np.r_[first[far], np.maximum(first, at - HALF + 1)[near]], np.r_[np.minimum(last, at - HALF)[far], last[near]]
        h = mixed(h[anchor] * np.uint64(pow(_BASE, TRIGGER, 1 << 64)) + h[anchor + TRIGGER])
        return first2 + base, last2 + base, at2 + base, h


class Chunk:
    """Documents of one chunk file, parsed."""

    def __init__(self, uri: str):
        self.rows = read_chunk(uri)
        text = self.rows.column("text").combine_chunks() if self.rows.num_rows else pa.array([], pa.string())
        text = (text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_string()).fill_null("")
        raw = b"".join(x.as_buffer() for x in text.cast(pa.large_binary())) if text.offset else None
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
        self.data = np.frombuffer(raw if raw is not None else (text.buffers()[2] or b""), np.uint8)[: int(self.offsets[-1]) if len(self.offsets) else 0]
        self.ids = np.asarray(self.rows.column("doc_id").cast(pa.int64()).fill_null(int(_LAST)).combine_chunks())
        self.parse = Parse(self.data, self.offsets)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes in rising order, and whether each stands in several texts of the chunk."""
        order, new = self._by_hash()
        h, text = self.parse.hash[order], self.parse.text[order]
        return h[new[:-1]], text[new[:-1]] != text[new[1:]]

    def _by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs in the order of their anchors' hashes, and a mark on each first of a hash and past the end."""
        order = np.argsort(self.parse.hash, kind="stable")
        h = self.parse.hash[order]
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = h[1:] != h[:-1]
        return order, new if len(h) else np.zeros(1, bool)

    def pairs(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs at repeated anchors, the distinct pairs of phrases in the order of their anchors' hashes, each run's pair, and each pair's hash."""
        p = self.parse
        order, new = self._by_hash()
        hit = np.sort(order[repeated[np.cumsum(new[:-1]) - 1]])
        at, far = p.at[hit], p.at[hit] - p.first[hit]  # far: windows start up to so many bytes before the trigger
        near = p.at[hit] - p.last[hit]
        table = np.zeros((len(hit), _ROW), np.uint8)
        n = len(self.data)
        for k in range(LEFT):
            table[:, k] = np.where(k < far, self.data[np.maximum(at - 1 - k, 0)], 0)
        for k in range(SPAN):
            table[:, LEFT + k] = np.where(k < SPAN - near, self.data[np.minimum(at + k, n - 1)], 0)
        table[:, -2], table[:, -1] = near, far
        kept, own = distinct_rows(table, p.hash[hit])
        return hit, table[kept], own, p.hash[hit][kept]


def _send(parts: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for uri in b.column("chunk").to_pylist():
                h, many = Chunk(uri).anchors()
                cut = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
                low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield row_batch([(f, uri, int(y - x), low[x:y].tobytes(), np.packbits(many[x:y]).tobytes()) for f, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x or f == 0], _ANCHORS)

    return run


def _answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in groups(rows, "frag"):
        low = [np.frombuffer(r["low"], "<u4") for r in own]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=r["n"]) for r in own])
        _, at, n = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        repeated = (n[at] > 1) | many.astype(bool)
        ends = np.cumsum([0, *map(len, low)])
        yield row_batch([(r["frag"], r["chunk"], r["n"], np.packbits(repeated[x:y]).tobytes()) for r, x, y in zip(own, ends, ends[1:], strict=False)], _ANSWERS)


def _send_pairs(parts: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(rows, "chunk"):
            own.sort(key=lambda r: r["frag"])
            repeated = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in own]).astype(bool)
            c = Chunk(own[0]["chunk"])
            hit, pairs, run_pair, h = c.pairs(repeated)
            least = np.full(len(pairs), _LAST)
            np.minimum.at(least, run_pair, c.ids[c.parse.text[hit]])
            cut = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
            out = [(b, own[0]["chunk"], 0, packed(pairs[x:y].tobytes()), packed(least[x:y].tobytes())) for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
            # the chunk's own bits pass through a bucket of their own
            yield row_batch([(-1 - crc(own[0]["chunk"]) % parts, own[0]["chunk"], 1, np.packbits(repeated).tobytes(), len(repeated).to_bytes(8, "little")), *out], _PAIRS)

    return run


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row among the sorted distinct rows, and each rank's common prefix with the one before (0 for the first)."""
    t, rank = sorted_rows(rows)
    differ = np.ones((len(t), t.shape[1] + 1), bool)
    np.not_equal(t[1:], t[:-1], out=differ[1:, :-1])
    lcp = differ.argmax(axis=1)
    lcp[:1] = 0
    return rank, lcp


def smallest_ids(pairs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each window of each pair, flat from the pair's nearest to its farthest window, and where each pair's begin.

    Windows r bytes before their trigger are equal if the left phrases agree in r bytes before it and the right ones in SPAN - r.
    """
    near, far = pairs[:, -2].astype(np.int64), pairs[:, -1].astype(np.int64)
    left, left_lcp = ranked(pairs[:, :LEFT])
    right, right_lcp = ranked(pairs[:, LEFT : LEFT + SPAN])
    begins = np.r_[0, np.cumsum(far - near + 1)]
    out = np.empty(begins[-1], np.int64)
    for r in range(WINDOW):
        sel = np.flatnonzero((near <= r) & (r <= far))
        if not len(sel):
            continue
        key = np.cumsum(left_lcp < r)[left[sel]].astype(np.int64) * (len(right_lcp) + 1) + np.cumsum(right_lcp < SPAN - r)[right[sel]]
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.minimum.reduceat(ids[sel][order], start)
        out[begins[sel[order]] + r - near[sel[order]]] = np.repeat(least, np.diff(np.r_[start, len(k)]))
    return out, begins


def _order(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in groups(rows, "bucket"):
        if own[0]["kind"] == 1:
            for r in own:
                yield row_batch([tuple(r.values())], _PAIRS)
            continue
        parts = [np.frombuffer(unpacked(r.pop("pairs")), np.uint8).reshape(-1, _ROW) for r in own]
        both = np.concatenate(parts)
        kept, at = distinct_rows(both)
        kept, ids = both[kept], np.full(len(kept), _LAST)
        np.minimum.at(ids, at, np.concatenate([np.frombuffer(unpacked(r.pop("ids")), np.int64) for r in own]))
        found, begins = smallest_ids(kept, ids)
        size = np.diff(begins)
        ends = np.cumsum([0, *map(len, parts)])
        for r, x, y in zip(own, ends, ends[1:], strict=False):
            mine = at[x:y]
            flat = np.repeat(begins[mine], size[mine]) + steps(size[mine])
            yield row_batch([(r["bucket"], r["chunk"], 0, b"", packed(found[flat].tobytes()))], _PAIRS)


def removed(c: Chunk, hit: np.ndarray, run_pair: np.ndarray, pairs: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """A mark on each byte of the chunk that a window covers which a smaller id has too."""
    near, far = pairs[:, -2].astype(np.int64), pairs[:, -1].astype(np.int64)
    size = far - near + 1
    begins = np.cumsum(size) - size
    starts = []
    for x in range(0, len(hit), 50_000):
        part = slice(x, x + 50_000)
        own, runs = run_pair[part], hit[part]
        n = size[own]
        step = steps(n)
        cut = smallest[np.repeat(begins[own], n) + step] < np.repeat(c.ids[c.parse.text[runs]], n)
        starts.append((np.repeat(c.parse.at[runs] - near[own], n) - step)[cut])
    mask = np.zeros(len(c.data), bool)
    s = np.sort(np.concatenate([np.zeros(0, np.int64), *starts]))
    gap = np.flatnonzero(s[1:] > s[:-1] + SPAN)
    for a, b in zip(s[np.r_[0, gap + 1]].tolist(), s[np.r_[gap, len(s) - 1]].tolist(), strict=True) if len(s) else ():
        mask[a : b + SPAN] = True
    return mask


def _cut(make):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(rows, "chunk"):
            own.sort(key=lambda r: r["bucket"])
            repeated = np.unpackbits(np.frombuffer(own[0]["pairs"], np.uint8), count=int.from_bytes(own[0]["ids"], "little")).astype(bool)
            c = Chunk(own[0]["chunk"])
            hit, pairs, run_pair, _ = c.pairs(repeated)
            smallest = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(unpacked(r["ids"]), np.int64) for r in own[1:])])
            yield from make(c, removed(c, hit, run_pair, pairs, smallest))

    return run


def _passes(docs: DataFrame, make, schema) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    width = partitions(spark)
    chunks = chunked(docs, scratch(spark, "texts"), CHUNK)
    n, size = chunks.selectExpr("count(*)", "coalesce(sum(n_bytes), 0)").first()
    parts = by_parts(int(size), 2 * CHUNK, 8)
    bits = chunks.select("chunk").repartition(max(1, n)).mapInArrow(lean(_send(parts)), _ANCHORS).repartition(width, "frag").sortWithinPartitions("frag", "chunk").mapInArrow(lean(_answer), _ANSWERS)
    sent = bits.repartition(width, "chunk").sortWithinPartitions("chunk").mapInArrow(lean(_send_pairs(parts)), _PAIRS)
    ids = sent.repartition(width, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(_order), _PAIRS)
    return ids.repartition(width, "chunk").sortWithinPartitions("chunk").mapInArrow(lean(_cut(make)), schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(c: Chunk, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = []
    for a, b in zip(c.offsets.tolist(), c.offsets[1:].tolist(), strict=False):
        own = cut[a:b]
        out.append((b - a, n := int(own.sum()), int(own[:1].sum() + (own[1:] > own[:-1]).sum()), hashlib.sha256((c.data[a:b][~own] if n else c.data[a:b]).tobytes()).hexdigest()))
    yield pa.RecordBatch.from_arrays([c.rows.column("doc_id").cast(pa.int64()).combine_chunks(), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), pa.array([x[3] for x in out], pa.string())], [x.split()[0] for x in DIGEST.split(", ")])


def digest(docs: DataFrame) -> DataFrame:
    """What is cut from each document, and a digest of what is left of it."""
    return _passes(docs.select("doc_id", "text"), _digests, DIGEST)


def dedup(docs: DataFrame, to: str = "n_removed") -> DataFrame:
    """docs with the repeated bytes cut out of `text` and their count in column `to` (a column of that name is replaced)."""
    docs = docs.drop(to)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.LongType())])

    def make(c: Chunk, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = c.offsets.tolist()
        n = [int(cut[a:b].sum()) for a, b in zip(ends, ends[1:], strict=False)]
        old = c.rows.column("text").to_pylist()
        texts = [t if not k else c.data[a:b][~cut[a:b]].tobytes().decode(errors="ignore") for t, k, a, b in zip(old, n, ends, ends[1:], strict=False)]
        rows = c.rows.combine_chunks()
        for b in rows.set_column(names.index("text"), "text", pa.array(texts, pa.string())).append_column(to, pa.array(n, pa.int64())).to_batches():
            yield b

    return _passes(docs, make, schema)
