"""Benchmark decontamination by SimHash over item-sized windows.

Texts are compared as words (letters, digits and underscores, lower case; other characters are dropped from a word). A window of as
many words as a benchmark item has, at any place of a document, is a candidate if its SimHash of BITS bits, over its five-word shingles with
their counts as weights, lies within RADIUS bits of the item's. At the threshold two sets of shingles differ in 15 % of the bits, 19 of
128 with a deviation of 4, so that the radius of 31 holds all but one in a thousand. Fingerprints are found by a multi-index: of eight
blocks of 16 bits one at least differs in three bits or fewer, so that tables of blocks that look that far miss none within the
radius; they look at 8 % of the items. Candidates are verified by the exact weighted Jaccard similarity of the shingles' counts, sum of
minima by sum of maxima, as are the windows beside them.

Only windows that share enough shingles are hashed at all: a similar one has at least similarity / (1 + similarity) of all its and the item's
shingles in common. An exact way is left for pairs that the index does not give (one shingle that repeats turns a fingerprint far): a
similar window has one of the item's rarest shingles, of which one more is listed than it may lack, and for pairs not yet found
the windows at such a shingle are verified. `rest=False` switches it off.

A document shorter than an item is one window. Texts with fewer words than a shingle are one shingle of all their words. Null and
wordless texts and items match nothing. Repeated documents are searched one by one; repeated items give repeated pairs. A null
doc_id or item_id is carried as null. Extra columns are ignored. The benchmark is collected in blocks of a bounded size; a larger
one takes more blocks, each against all documents.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import lean, slices, small_batches, texts_of

SHINGLE = 5
SIMILARITY = 0.8
BITS, RADIUS = 128, 31
#: Bits of a block of a fingerprint, of which a block's table holds items one bit off and a look-up goes two bits further.
BLOCK_BITS = 16
#: Windows that are hashed at once, and words between two windows past which they are hashed apart.
WINDOWS = 16_384
GAP = 256
#: Bytes of benchmark text that one pass ships to the executors.
BLOCK_BYTES = 32_000_000
SLICE = 2_000_000
MEMORY = 200_000
_MASK = (1 << 20) - 1
FOUND = "doc_id long, item_id long, similarity double, first_word long"
_DROP = re.compile(r"\W+")


class _Words(dict):
    """Hash of a word's letters and digits; 0 for none."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        word = _DROP.sub("", raw.decode().lower())
        found = self[raw] = (xxhash.xxh64_intdigest(word) | 1) if word else 0
        return found


_WORDS = _Words()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts end to end, and where each text's begin."""
    each = [t.encode().split() for t in texts]
    flat = np.fromiter((_WORDS[w] for e in each for w in e), np.uint64, sum(map(len, each)))
    ends = np.cumsum([0, *map(len, each)])
    keep = flat != 0
    return flat[keep], np.r_[0, np.cumsum(keep)][ends]


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of the `width` words from each place on."""
    h = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += words[k : k + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each hash, stretched to that many."""
    more = [h]
    for k in range(1, BITS // 64):
        x = (h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        more.append((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) ^ h >> np.uint64(7))
    wide = np.stack(more, axis=1).astype("<u8")
    return np.unpackbits(wide.view(np.uint8).reshape(len(h), BITS // 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of blocks of bits."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(f"<u{BLOCK_BITS // 8}")


def flips(most: int) -> np.ndarray:
    """Block values with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in itertools.combinations(range(BLOCK_BITS), n)], np.uint16)


_ONE, _TWO = flips(1), flips(2)


class SizeIndex:
    """Items of one size: a table for each block of their fingerprints, and the items' shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int):
        self.items, self.radius = items, radius
        self.prints = fingerprints(np.stack([bits(s).sum(axis=0) for _, s in items]))
        if radius // self.prints.shape[1] > 3:
            raise ValueError("a block's table looks three bits far")
        self.tables = []
        for k in range(self.prints.shape[1]):
            value = (self.prints[:, k, None] ^ _ONE).ravel()
            order = np.argsort(value, kind="stable")
            held = np.zeros(1 << BLOCK_BITS, bool)
            held[value] = True
            self.tables.append((held, order // len(_ONE), value[order]))

    def looked_at(self, prints: np.ndarray) -> np.ndarray:
        """Distinct (window, item) pairs of which a block differs in three bits or fewer, as window * items + item."""
        found = [np.zeros(0, np.int64)]
        for k, (held, item, value) in enumerate(self.tables):
            v = prints[:, k, None] ^ _TWO
            w, at = np.nonzero(held[v])
            v = v[w, at]
            lo, hi = np.searchsorted(value, v, "left"), np.searchsorted(value, v, "right")
            n = hi - lo
            place = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.unique(np.repeat(w, n) * len(self.items) + item[place]))
        return np.unique(np.concatenate(found))

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """Distinct (window, item) pairs within the radius, as window * items + item."""
        found = []
        for a in range(0, len(prints), 512):
            pairs = self.looked_at(prints[a : a + 512])
            w, k = pairs // len(self.items), pairs % len(self.items)
            near = np.bitwise_count(prints[a + w] ^ self.prints[k]).sum(axis=1) <= self.radius
            found.append(pairs[near] + a * len(self.items))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Benchmark:
    """Index of benchmark items: which sizes and items a shingle leads to."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int, similarity: float, rest: bool = True):
        flat, starts = word_hashes([t or "" for _, t in items])
        self.ids = [i for i, _ in items]
        self.similarity = similarity
        by_size: dict[int, list] = defaultdict(list)
        owners: dict[int, set[int]] = defaultdict(set)
        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            if b > a:
                s = own_shingles(flat[a:b])
                by_size[int(b - a)].append((k, s))
                for x in s.tolist():
                    owners[x].add(int(b - a))
        self.sizes = {n: SizeIndex(v, radius) for n, v in by_size.items()}
        # the rarest shingles of each item, by how many items hold them: all but as many as a similar window must share, and one more
        often = Counter(x for v in by_size.values() for _, s in v for x in set(s.tolist()))
        self.rare: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, v in by_size.items() if rest else ():
            for k, (_, s) in enumerate(v):
                left = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1  # the sum of minima is at least similarity * the sum of maxima
                for x in sorted(set(s.tolist()), key=lambda x: (often[x], x)):
                    self.rare[x].append((n, k))
                    left -= int((s == x).sum())
                    if left <= 0:
                        break
        self.owners = {x: sorted(v) for x, v in owners.items()}
        self.known = np.array(sorted(owners), np.uint64)
        self.maybe = np.zeros(_MASK + 1, bool)
        self.maybe[(self.known & np.uint64(_MASK)).astype(np.int64)] = True

    def search(self, words: np.ndarray, s: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window for each item that a document holds; hits: places of shared shingles."""
        at_size: dict[int, list[int]] = defaultdict(list)
        rare: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for p, x in zip(hits.tolist(), s[hits].tolist(), strict=True):
            for n in self.owners[x]:
                at_size[n].append(p)
            for n, k in self.rare.get(x, ()):
                rare[n][k].append(p)
        for n, places in at_size.items():
            index = self.sizes[n]
            size = min(n, len(words))
            width = min(SHINGLE, n)
            wide = s if width == SHINGLE and len(words) >= SHINGLE else shingles(words, min(width, len(words)))
            count = size - min(width, len(words)) + 1  # shingles in a window
            last = len(words) - size
            need = self._least(count + n - width + 1)
            if need > min(count, len(places)):
                continue
            p = np.asarray(places)
            edge = np.zeros(last + 2, np.int32)
            np.add.at(edge, np.clip(p - count + 1, 0, last), 1)
            np.add.at(edge, np.minimum(p, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) >= need)
            found: dict[int, tuple[float, int]] = {}

            def keep(k: int, near: np.ndarray, index: SizeIndex = index, wide: np.ndarray = wide, count: int = count, found: dict = found) -> None:
                best = self._best(wide, index.items[k][1], near, count) if len(near) else None
                if best and (k not in found or (best[0], -best[1]) > (found[k][0], -found[k][1])):
                    found[k] = best

            for near in _runs(starts, WINDOWS):
                low, high = int(near[0]), int(near[-1]) + count
                sums = np.zeros((high - low + 1, BITS), np.int32)
                np.cumsum(bits(wide[low:high]), axis=0, out=sums[1:])
                pairs = index.candidates(fingerprints(sums[near - low + count] - sums[near - low]))
                for k in np.unique(pairs % len(index.items)).tolist():
                    at = near[pairs[pairs % len(index.items) == k] // len(index.items)]
                    # the windows beside a candidate are verified with it, so that the best of them is reported
                    after = at[np.minimum(np.searchsorted(at, near), len(at) - 1)]
                    before = at[np.maximum(np.searchsorted(at, near, "right") - 1, 0)]
                    keep(k, near[np.minimum(abs(after - near), abs(near - before)) < count])
            for k, at in rare[n].items():
                if k in found:
                    continue
                at = np.asarray(at)
                # windows that hold a rare shingle of the item
                after = at[np.minimum(np.searchsorted(at, starts), len(at) - 1)]
                for near in _runs(starts[(after >= starts) & (after < starts + count)], WINDOWS):
                    keep(k, near)
            for k, (value, first) in found.items():
                yield index.items[k][0], value, first

    def _least(self, both: int) -> int:
        """Shingles that a window and an item with so many together must share."""
        return math.ceil(self.similarity / (1 + self.similarity) * both - 1e-9)

    def _best(self, wide: np.ndarray, own: np.ndarray, starts: np.ndarray, count: int) -> tuple[float, int] | None:
        """The most similar of the candidate windows, the first on ties, if it reaches the threshold."""
        kinds, weight = np.unique(own, return_counts=True)
        low, high = int(starts.min()), int(starts.max()) + count
        at = np.minimum(np.searchsorted(kinds, wide[low:high]), len(kinds) - 1)
        member = kinds[at] == wide[low:high]
        upto = np.r_[0, np.cumsum(member)]
        most = upto[starts - low + count] - upto[starts - low]  # at least the sum of minima
        best = None
        for s in starts[most >= self._least(count + len(own))].tolist():
            part = slice(s - low, s - low + count)
            got = np.bincount(at[part][member[part]], minlength=len(kinds))
            least = int(np.minimum(got, weight).sum())
            value = least / (count + len(own) - least)
            if value >= self.similarity - 1e-12 and (best is None or value > best[0]):
                best = (value, s)
        return best


def _runs(starts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rising places cut where a gap or `most` places end a run: what is worked out for a run stays small."""
    if len(starts):
        cuts = np.flatnonzero(np.diff(starts) > GAP) + 1
        for part in np.split(starts, cuts):
            for a in range(0, len(part), most):
                yield part[a : a + most]


def own_shingles(words: np.ndarray) -> np.ndarray:
    return shingles(words, min(SHINGLE, len(words)))


class Items:
    """Benchmark items as they are shipped; a worker makes their index once and keeps it with the broadcast."""

    def __init__(self, items: list[tuple], radius: int, similarity: float, rest: bool):
        self.given, self.made = (items, radius, similarity, rest), None

    def __getstate__(self) -> dict:
        return {"given": self.given, "made": None}

    def index(self) -> Benchmark:
        if self.made is None:
            self.made = Benchmark(*self.given)
        return self.made


def _held(bench: Benchmark, texts: list[str]) -> Iterator[tuple[int, int, float, int]]:
    """(text's place, item's place, similarity, first word) for each item that a text holds."""
    widths = {SHINGLE, *(n for n in bench.sizes if n < SHINGLE)}
    for x, y in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
        flat, starts = word_hashes(texts[x:y])
        hit = {}
        for w in widths:
            s = shingles(flat, w)
            at = np.flatnonzero(bench.maybe[(s & np.uint64(_MASK)).astype(np.int64)]) if len(bench.known) else np.zeros(0, np.int64)
            at = at[bench.known[np.minimum(np.searchsorted(bench.known, s[at]), len(bench.known) - 1)] == s[at]] if len(at) else at
            text = np.searchsorted(starts, at, "right") - 1
            hit[w] = (s, at[at + w <= starts[text + 1]] if len(at) else at)
        touched = np.unique(np.concatenate([np.searchsorted(starts, at, "right") - 1 for _, at in hit.values()]))
        for k in touched.tolist():
            a, e = int(starts[k]), int(starts[k + 1])
            best: dict[int, tuple[float, int]] = {}
            for s, at in hit.values():
                own = at[np.searchsorted(at, a) : np.searchsorted(at, e)] - a
                if len(own):
                    for item, value, first in bench.search(flat[a:e], s[a : max(a, e - SHINGLE + 1)] if e - a >= SHINGLE and s is hit[SHINGLE][0] else s[a:e], own):
                        if item not in best or (value, -first) > (best[item][0], -best[item][1]):
                            best[item] = (value, first)
            for item, (value, first) in best.items():
                yield x + k, item, value, first


def _blocks(docs: DataFrame, benchmark: DataFrame, radius: int, similarity: float, rest: bool = True) -> Iterator[Broadcast]:
    """The benchmark in blocks of a bounded size, each shipped to the executors."""
    spark = docs.sparkSession
    small_batches(spark)
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = int(b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        items = [tuple(r) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        yield spark.sparkContext.broadcast(Items(sorted(items, key=repr), radius, similarity, rest))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, rest: bool = True) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for each item that a document holds; without `rest`, what the fingerprints give alone."""

    def search(shipped: Broadcast) -> DataFrame:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shipped.value.index()
            for b in rows:
                ids = b.column("doc_id").cast(pa.int64()).to_pylist()
                out = [(ids[k], bench.ids[item], round(v, 6), f) for k, item, v, f in _held(bench, texts_of(b))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], [c.split()[0] for c in FOUND.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(lean(run), FOUND)

    return functools.reduce(DataFrame.unionByName, map(search, _blocks(docs, benchmark, radius, similarity, rest)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that hold an item. Rows are judged where they are read, each by its own text: doc_ids may be null or repeat."""

    def leave_out(left: DataFrame, shipped: Broadcast) -> DataFrame:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shipped.value.index()
            for b in rows:
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, *_ in _held(bench, texts_of(b))]] = False
                yield b if keep.all() else b.filter(pa.array(keep))

        return left.mapInArrow(lean(run), docs.schema)

    return functools.reduce(leave_out, _blocks(docs, benchmark, radius, similarity), docs)
