"""Audit of how filters overlap: what each order of five filters removes at each step, by source.

1. One pass over the Arrow buffers of the texts. A table gives each byte its classes; prefix sums over the classes count words, capitals,
   code points and symbols of every text in a slice at once; distinct words are counted from each text's sorted word hashes, where
   neighbours of equal hash are verified byte by byte. A text leaves the pass as a mask of failed filters and a digest of 128 bits.
2. The duplicate filter needs the table: per digest the smallest doc_id, found by an aggregate with a partial step. Copies are never
   gathered: rows are counted as failing it, and those that carry their digest's smallest doc_id are counted back.
3. Counts by (part, mask) are at most 32 rows a part. What each of the 120 orders removes, finds redundant and loses at each step follows
   from these counts by one matrix product with the masks of orders and steps.

A text longer than SLICE bytes is counted in pieces cut at white space; its distinct words are held as a set.

Null text: empty. Null source: the empty part. Null doc_id: never a duplicate, makes none, and has no label. Repeated rows of one doc_id and
text are not duplicates of each other. Labels of a repeated doc_id: good or toxic if any row says so. No documents: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import lean, slices, small_batches, stored
from memloom.llm.words import buffer_of, class_table, distinct_within, find_words, prefix_sums, word_hash

#: Filters, in the order of their bits; E is the duplicate filter.
FILTERS = "ABCDE"
DUPLICATE = 16
#: Bytes of text that are scanned at once, and texts at once: groups of the distinct count lie below 2^20.
SLICE, ROWS = 2_000_000, 1 << 19
_SPACE = b" \t\n\v\f\r"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
#: Byte classes: white space, capitals, symbols, bytes that continue a code point.
_CLASSES = class_table(space=_SPACE, capital=_CAPITALS, symbol=_SYMBOLS, inner=bytes(range(0x80, 0xC0)))


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text, as rows; and the places of the distinct words."""
    kind = _CLASSES[data[:-8]]
    a, b = offsets[:-1], offsets[1:]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = prefix_sums(flags)
        return (sums[b] - sums[a]).astype(np.int64)

    words = find_words((kind & 1).astype(bool), offsets)
    begins = np.zeros(len(kind), bool)
    begins[words.start] = True
    n = per_text(begins)
    group = np.repeat(np.arange(len(n)), n)
    first, _ = distinct_within(data, words, group, word_hash(data, words))
    distinct = np.bincount(group[first], minlength=len(n))
    counted = np.stack([n, distinct, per_text(kind & 2 != 0), per_text(kind & 4 != 0), per_text(kind & 8 == 0)])
    return counted, np.stack([words.start[first], words.size[first]])


def _long(text: pa.Array) -> np.ndarray:
    """_counts of one text, in pieces."""
    data, offsets = buffer_of(text)
    size, total, seen, a = int(offsets[-1]), np.zeros(5, np.int64), set(), 0
    gaps = np.flatnonzero(_CLASSES[data[:size]] & 1)
    while a < size:
        k = int(np.searchsorted(gaps, a + SLICE)) if a + SLICE < size else len(gaps)
        b = int(gaps[k]) if k < len(gaps) else size
        piece = np.concatenate([data[a:b], np.zeros(8, np.uint8)])
        counted, (start, length) = _counts(piece, np.array([0, b - a]))
        total += counted[:, 0]
        raw = piece.tobytes()
        seen.update(raw[s : s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True))
        a = b + 1 if k < len(gaps) else size
        total[4] += b < size and k < len(gaps)  # the gap is a code point
    total[1] = len(seen)
    return total[:, None]


def failed(counted: np.ndarray) -> np.ndarray:
    """The mask of failed filters A to D."""
    n, distinct, capitals, symbols, points = counted
    tests = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * points, symbols > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each document; the mask lacks the duplicate filter."""

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            text = b.column("text")
            sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
            for x, y in slices(sizes, SLICE):
                for p in range(x, y, ROWS):
                    one = text.slice(p, min(y, p + ROWS) - p)
                    data, offsets = buffer_of(one)
                    counted = _long(one) if len(data) > 2 * SLICE else _counts(data, offsets)[0]
                    view = memoryview(data)
                    ends = offsets.tolist()
                    digests = [hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").slice(p, len(one)), pc.fill_null(b.column("part").slice(p, len(one)), ""), pa.array(failed(counted), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"]
                    )

    small_batches(docs.sparkSession)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("part"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(lean(f), "doc_id long, part string, mask int, digest binary")


def by_mask(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail just the filters of the mask, and how many of them are labelled so."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    rows = scan(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    # rows without an id match nothing and are spread by their digest, so that they don't meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    rows = rows.withColumn("spread", spread).join(said.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").drop("spread")
    rows = stored(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")}), "masks")
    least = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(least, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id IS NULL"))
    n = F.col("n")
    marked = rows.select("part", F.col("mask").bitwiseOR(DUPLICATE).alias("mask"), n, "good", "bad").unionByName(
        firsts.select("part", F.explode(F.array(F.struct(F.col("mask").alias("m"), n.alias("k")), F.struct(F.col("mask").bitwiseOR(DUPLICATE).alias("m"), (-n).alias("k")))).alias("x"), "good", "bad").select("part", F.col("x.m").alias("mask"), F.col("x.k").alias("n"), "good", "bad")
    )
    sums = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), n).otherwise(0)).alias(to) for c, to in (("good", "good"), ("bad", "toxic"))))
    return sums.where("n > 0")


def _orders() -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders of the filters, and for each order and step which of the 32 masks count as kept, removed, redundant and removed alone."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = np.array([[1 << FILTERS.index(x) for x in o] for o in orders])
    before = np.cumsum(bits, axis=1) - bits
    mask = np.arange(32)[:, None, None]
    fails, earlier = mask & bits != 0, mask & before != 0
    sets = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": mask == bits}
    return orders, {k: v.reshape(32, -1).astype(np.int64) for k, v in sets.items()}


_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def every_order(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step from (part, mask, n, good, toxic)."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, sets = _orders()
        steps = len(FILTERS)
        at = np.array([[FILTERS.index(x) for x in o] for o in orders]).ravel()
        for b in rows:
            for part, held in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                n, good, toxic = (np.zeros(32, np.int64) for _ in range(3))
                for c in held:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                out = {k: n @ v for k, v in sets.items()}
                out |= {"good_lost": good @ sets["removed"], "toxic_lost": toxic @ sets["removed"]}
                share = np.zeros(steps, np.int64)
                np.add.at(share, at, out["removed"])
                out["shapley"] = share[at]
                head = [pa.array([part] * len(at)), pa.array(np.repeat(orders, steps).tolist()), pa.array(np.tile(np.arange(1, steps + 1), len(orders)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(out[c]) for c in _COLUMNS)], ["part", "filter_order", "step", *_COLUMNS])

    return cells.mapInArrow(f, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    return every_order(by_mask(docs, labels))
