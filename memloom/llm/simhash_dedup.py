"""Near-duplicates by SimHash: every link of fingerprints at RADIUS or fewer differing bits, found in Gray-order hierarchical indexes.

1. A document's fingerprint is the bitwise majority of its shingles' XXH64. Equal fingerprints are one node, so that copies cost nothing.
2. The 64 bits are cut into blocks. Two fingerprints within RADIUS bits agree on some choice of (blocks - RADIUS) blocks, so the distinct
   fingerprints are laid out once for each choice, with the chosen blocks leading, and meet in buckets of equal leading bits. How many blocks
   follows from the count of fingerprints, so that buckets stay small; the links found are the same for any number.
3. Within a bucket fingerprints stand by Gray rank, in which neighbours differ in few bits. Runs of FANOUT neighbours are a node that holds the
   bits they all share; nodes are grouped again, up to one root. The bits in which the patterns of two nodes disagree, gathered from the roots
   down, are differences of all pairs below them: past RADIUS both groups go at once. Groups that earlier links already joined go too.
4. A bucket of more than TILE fingerprints is range-cut along Gray rank to tiles; pairs of tiles whose shared bits already differ too much are
   dropped, and the others are tasks of their own. A task reports a spanning forest of its links, and components join the forests.

Texts are whole; one longer than PIECE is read in pieces that overlap by two words. Null or empty text, or no words: fingerprint zero, linked
like any other. Null doc_id: never a component's name unless it has no other. Repeated rows are copies: each gives a row. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.chunks import steps
from memloom.llm.common import lean, partitions, small_batches, stored
from memloom.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Bytes of a text that are cut to words at once.
PIECE = 1 << 20
#: Fingerprints that one index holds; larger buckets are cut to tiles.
TILE = 8192
#: Fingerprints that a task works on at once, and pairs of nodes that it looks at together.
SLAB, PAIRS = 1 << 17, 1 << 20
FANOUT = 8
#: Oversized buckets that may be broadcast, 24 bytes each.
BROADCAST = 500_000
_GAP = re.compile(rb"[\t-\r ]")


def shingles(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the shingles of a text, repeats included; with fewer words, the whole sequence, and none without words."""
    text, a, held, short = text.lower(), 0, [], True  # bytes: A-Z alone
    while a < len(text):
        gap = _GAP.search(text, a + PIECE) if a + PIECE < len(text) else None
        b = gap.start() if gap else len(text)
        w = held + text[a:b].split()
        if len(w) >= WORDS:
            short = False
            yield [b" ".join(x) for x in zip(*(w[k:] for k in range(WORDS)), strict=False)]
        held, a = w[max(0, len(w) - WORDS + 1) :] if len(w) >= WORDS else w, b
    if short and held:
        yield [b" ".join(held)]


def fingerprint(text: bytes) -> int:
    """The bits that more than half of the shingles' hashes have set."""
    n, ones = 0, np.zeros(64, np.int64)
    for found in shingles(text):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), "<u8", len(found))
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed number."""

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [fingerprint(x or b"") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(f), "doc_id long, fp long")


def layouts(blocks: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of leading blocks, all blocks (lowest bit, width) from the top down, and the width of the lead."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    fields = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for lead in combinations(range(blocks), blocks - RADIUS):
        order = [*lead, *(k for k in range(blocks) if k not in lead)]
        out.append(([fields[k] for k in order], sum(fields[k][1] for k in lead)))
    return out


def blocks_for(n: int) -> int:
    """The fewest blocks that leave half a TILE or less in a bucket, were fingerprints even."""
    blocks = RADIUS + 1
    while blocks < 16 and n >> min(lead for _, lead in layouts(blocks)) > TILE // 2:
        blocks += 1
    return blocks


def laid(fp: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in the given order."""
    out = np.zeros(len(fp), np.uint64)
    for low, width in fields:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def unlaid(bits: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(bits), np.uint64), 64
    for low, width in fields:
        at -= width
        out |= ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(low)
    return out


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each number in the Gray code."""
    r = bits.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


class Index:
    """Runs of fingerprints in Gray order, each under a root; level 0 is the fingerprints, and a node's pattern is what all below it share."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits = bits
        self.first: list[np.ndarray] = [np.arange(len(bits))]
        self.count: list[np.ndarray] = [np.ones(len(bits), np.int64)]
        self.ones, self.zeros = [bits], [~bits]
        self.items = [np.arange(len(bits))]  # the first fingerprint below each node
        while (sizes > 1).any() or len(self.first) == 1:
            above = -(-sizes // FANOUT)
            own = np.minimum(FANOUT, np.repeat(sizes, above) - FANOUT * steps(above))
            start = np.cumsum(own) - own
            self.first.append(start)
            self.count.append(own)
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], start))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], start))
            self.items.append(self.items[-1][start])
            sizes = above

    def apart(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which all below node i differ from all below node j."""
        one, zero = self.ones[level], self.zeros[level]
        return np.bitwise_count((one[i] & zero[j]) | (zero[i] & one[j]))

    def forest(self, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each fingerprint a smaller place, or its own, in the same component of the links between the given pairs of runs."""
        parent = np.arange(len(self.bits))
        i, j = pairs
        ends = self.items[-1]
        inner = np.ones(len(self.bits), bool)
        inner[ends] = False
        k = np.flatnonzero(inner & np.isin(np.cumsum(~inner) - 1, i[i == j]))
        k = k[np.bitwise_count(self.bits[k] ^ self.bits[k - 1]) <= RADIUS]
        _unite(parent, k - 1, k)  # neighbours first
        low, high = [parent], [parent]
        for start in self.first[1:]:
            low.append(np.minimum.reduceat(low[-1], start))
            high.append(np.maximum.reduceat(high[-1], start))
        low, high = [x.copy() for x in low], [x.copy() for x in high]
        stack = [(len(self.first) - 1, i, j)]
        while stack:
            level, i, j = stack.pop()
            size = self.count[level][i] * self.count[level][j]
            if len(i) > 1 and size.sum() > PAIRS:
                half = len(i) // 2
                stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            at, each = steps(size), np.repeat(self.count[level][j], size)
            x, y = np.repeat(self.first[level][i], size) + at // each, np.repeat(self.first[level][j], size) + at % each
            keep = (x <= y) | np.repeat(i != j, size)
            keep &= self.apart(level - 1, x, y) <= RADIUS
            if level == 1:
                keep &= x != y
                _unite(parent, x[keep], y[keep])
                continue
            one = low[level - 1]
            keep &= (one[x] != one[y]) | (one[x] != high[level - 1][x]) | (one[y] != high[level - 1][y])
            if keep.any():
                stack.append((level - 1, x[keep], y[keep]))
        return parent


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; parents are roots before and after."""
    while True:
        a, b = parent[i], parent[j]
        live = a != b
        if not live.any():
            return
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _slabs(rows: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows as columns, about SLAB at once, cut only where a key changes."""
    held: dict[str, np.ndarray] = {}
    for b in rows:
        got = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)}
        held = {n: np.concatenate([held[n], c]) for n, c in got.items()} if held else got
        n = len(held["rank"])
        if n >= SLAB:
            cut = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in keys], axis=0))
            if len(cut):
                yield {n: c[: cut[-1] + 1] for n, c in held.items()}
                held = {n: c[cut[-1] + 1 :] for n, c in held.items()}
    if held and len(held["rank"]):
        yield held


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _edges(bits: np.ndarray, turn: np.ndarray, parent: np.ndarray, blocks: int) -> pa.RecordBatch:
    own = np.flatnonzero(parent != np.arange(len(parent)))
    a, b = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
    for t, (fields, _) in enumerate(layouts(blocks)):
        k = np.flatnonzero(turn[own] == t)
        a[k], b[k] = unlaid(bits[own[k]], fields), unlaid(bits[parent[own[k]]], fields)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints `fp`, all different, whose components are those of all links."""
    spark = distinct.sparkSession
    blocks = blocks or blocks_for(distinct.count())

    def lay(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for t, (fields, lead) in enumerate(layouts(blocks)):
                bits = laid(fp, fields)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array((bits >> np.uint64(64 - lead)).view(np.int64)), pa.array(gray_rank(bits).view(np.int64))], ["turn", "lead", "rank"])

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slabs(rows, ("turn", "lead")):
            start = _changes([s["turn"], s["lead"]])
            sizes = np.diff(np.append(start, len(s["rank"])))
            more = np.repeat(sizes > 1, sizes)
            if not more.any():
                continue
            bits, turn, sizes = gray_code(s["rank"][more].view(np.uint64)), s["turn"][more], sizes[sizes > 1]
            runs = np.arange(len(sizes))
            yield _edges(bits, turn, Index(bits, sizes).forest((runs, runs)), blocks)

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("turn", "lead", "one", "two")
        for s in _slabs(rows, keys):
            start = _changes([s[k] for k in (*keys, "tile")])
            sizes = np.diff(np.append(start, len(s["rank"])))
            bits = gray_code(s["rank"].view(np.uint64))
            runs = np.arange(len(start))
            alone, left = s["one"][start] == s["two"][start], s["tile"][start] == s["one"][start]
            i = runs[alone | left]
            yield _edges(bits, s["turn"], Index(bits, sizes).forest((i, np.where(alone[i], i, i + 1))), blocks)

    ranked = distinct.select("fp").mapInArrow(lay, "turn int, lead long, rank long")
    large = stored(ranked.groupBy("turn", "lead").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "buckets")
    n_large = large.count()
    named = large.select("turn", "lead")
    named = F.broadcast(named) if n_large <= BROADCAST else named
    light = ranked.join(named, ["turn", "lead"], "left_anti") if n_large else ranked
    found = light.repartition(partitions(spark), "turn", "lead").sortWithinPartitions("turn", "rank").mapInArrow(lean(search), "a long, b long")
    if not n_large:
        return found
    held = int(large.agg(F.sum("n")).first()[0])
    tiles = ranked.join(named, ["turn", "lead"], "left_semi").repartitionByRange(-(-2 * held // TILE), "turn", "rank")
    tiles = stored(tiles.withColumn("tile", F.spark_partition_id()), "tiles")
    bits = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1))
    shared = stored(tiles.groupBy("turn", "lead", "tile").agg(F.bit_and(bits).alias("ones"), F.bit_or(bits).alias("any")), "patterns")
    a, b = (shared.select("turn", "lead", F.col("tile").alias(n), F.col("ones").alias(f"ones_{n}"), F.col("any").alias(f"any_{n}")) for n in ("one", "two"))
    pairs = a.join(b, ["turn", "lead"]).where("one <= two").where(f"bit_count((ones_one & ~any_two) | (~any_one & ones_two)) <= {RADIUS}")
    to = pairs.select("turn", "lead", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"))
    sent = tiles.join(to, ["turn", "lead", "tile"])
    n = max(partitions(spark), -(-2 * held // TILE))
    met = sent.repartition(n, "turn", "lead", "one", "two").sortWithinPartitions("turn", "lead", "one", "two", "tile", "rank")
    return found.unionByName(met.select("turn", "lead", "one", "two", "tile", "rank").mapInArrow(lean(meet), "a long, b long"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document: 16 hexadecimal digits, and the smallest doc_id that links reach."""
    own = stored(fingerprints(docs), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(names, "root").select("fp", "component_id")
    return own.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
