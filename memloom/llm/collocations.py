"""Phrase collocations by language: exact counts of frequent phrases of two to four words, scored and thinned.

1. Documents lie in chunk files. A chunk hashes its runs of one to four words to the cells of a sketch, of a cell or two for every two bytes of
   all texts, and sends each cell's count, as much as LEAST, with the cells of one fragment of the sketch in one row.
2. A fragment adds up its cells. A cell's sum bounds the count of every phrase in it from above; the cells that reach LEAST go back to the
   chunks that have them. No phrase at or above LEAST can be lost; a few rare ones that share a cell with a frequent one come along.
3. A chunk compiles its own phrases in such cells to Aho-Corasick automata of bounded size, guarded by delimiters, so that matches are whole
   words, and scans its pieces for all overlapping matches. Words are counted by their number. A chunk sends its counts packed, in one row
   for each share of the phrases' hash range; sums over chunks are exact counts. The threshold is applied to these, and scores,
   containment and ranks are DataFrame plans over what is left.

An automaton holds only phrases of its own chunk, so that neither memory nor messages depend on how many candidates the corpus has. Scores
are whole numbers by decimals of 38 digits.

Null text: empty. Null lang: `und`, one with a lang of that name. doc_id plays no part; repeated rows count again. No words, no rows. Ties end
at the phrase, in the order of UTF-8 bytes. Extra columns are ignored. Texts are whole; a chunk's text is worked on in slices of
about SLICE bytes cut between pieces, so that one piece is the most that is held besides.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.chunks import chunked, groups, packed, read_chunk, row_batch, unpacked
from memloom.llm.common import lean, partitions, scratch, small_batches, stored
from memloom.llm.words import PAD, Words, distinct_within, find_words, mixed, word_hash

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bytes of text in a chunk, whose counts are one message, and in a slice of it.
CHUNK, SLICE = 16_000_000, 16_000_000
#: Bytes of text for each share of the phrases, whose counts are summed together.
SHARE = 4_000_000
#: Phrases in one automaton.
PATTERNS = 150_000
#: Parts in which a language's candidates are ranked before they meet: what meets is TOP rows of each.
SALT = 32
_BREAKS = b".,;:!?\n\v\f\r"
_SPACES = re.compile(rb" {2,}")
_PLAIN = bytes.maketrans(b"\t" + _BREAKS, b" " + b"\n" * len(_BREAKS))


def plain(texts: list[bytes]) -> bytes:
    """Texts in lower case (A-Z), one space between words, and ` \\n ` between pieces."""
    s = b"\n".join(texts).lower().translate(_PLAIN)
    return b" " + _SPACES.sub(b" ", s).replace(b"\n", b" \n ") + b" "


def by_lang(rows: pa.Table) -> Iterator[tuple[str, bytes]]:
    """The plain text of each language of a chunk, in slices that end between pieces."""
    lang, text = rows.column("lang").to_pylist(), rows.column("text").cast(pa.large_binary())
    own: dict[str, list[int]] = {}
    for k, x in enumerate(lang):
        own.setdefault("und" if x is None else x, []).append(k)
    for x, at in sorted(own.items()):
        s = plain([t or b"" for t in text.take(pa.array(at)).to_pylist()])
        a = 0
        while a < len(s):
            b = s.find(b"\n", a + SLICE) if a + SLICE < len(s) else -1
            b = len(s) if b < 0 else b
            yield x, s[a:b]
            a = b


class Text:
    """Words of a plain text, and hashes of the runs of one to four words from each of them that lie within a piece."""

    def __init__(self, lang: str, s: bytes):
        self.raw = s
        self.data = np.zeros(len(s) + PAD, np.uint8)
        self.data[: len(s)] = np.frombuffer(s, np.uint8)
        gap = (self.data[:-PAD] == 32) | (self.data[:-PAD] == 10)
        self.words: Words = find_words(gap, np.array([0, len(s)]))
        self.own = word_hash(self.data, self.words)
        piece = np.searchsorted(np.flatnonzero(self.data[:-PAD] == 10), self.words.start)
        seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        n = len(self.own)
        #: hash[k] has the runs of k + 1 words, within[k] whether they lie in one piece, by first word.
        self.hash, self.within = [mixed(self.own, seed)], [np.ones(n, bool)]
        for k in range(1, LONGEST):
            h, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
            if n > k:
                h[: n - k] = mixed(self.hash[-1][: n - k] * np.uint64(0xC2B2AE3D27D4EB4F), self.own[k:])
                ok[: n - k] = piece[: n - k] == piece[k:]
            self.hash.append(h)
            self.within.append(ok)

    def phrase(self, first: int, k: int) -> bytes:
        return self.raw[self.words.start[first] : self.words.start[first + k - 1] + self.words.size[first + k - 1]]


def sketch_bits(n_bytes: int) -> tuple[int, int]:
    """Bits of a cell's number, for a cell or two for every two bytes of text; and of its number within a fragment."""
    bits = min(60, max(16, math.ceil(math.log2(max(1, n_bytes))) - 1))
    return bits, min(bits, max(16, min(26, bits // 2 + 7)))


def cells_packed(cells: np.ndarray, counts: np.ndarray | None, start: int) -> bytes:
    """Rising cells of a fragment, as gaps; and counts if given."""
    gaps = np.diff(cells, prepend=start)
    width = 1 if gaps.max(initial=0) < 1 << 8 else 2 if gaps.max() < 1 << 16 else 4
    return packed(bytes([width]) + gaps.astype(f"<u{width}").tobytes() + (b"" if counts is None else counts.astype(np.uint8).tobytes()))


def cells_of(data: bytes, start: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = unpacked(data)
    width, rest = raw[0], len(raw) - 1
    n = rest // (width + counted)
    cells = start + np.cumsum(np.frombuffer(raw, f"<u{width}", n, 1), dtype=np.int64)
    return cells, np.frombuffer(raw, np.uint8, n if counted else 0, 1 + n * width)


_SKETCH = "chunk string, fragment long, data binary"


def upper_bounds(chunks: DataFrame, least: int, bits: int, low: int) -> DataFrame:
    """(chunk, fragment, data): the cells of each chunk whose sum over all chunks reaches `least`, and an empty row for each chunk."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for chunk in b.column("chunk").to_pylist():
                for lang, s in by_lang(read_chunk(chunk)):
                    t = Text(lang, s)
                    cells = np.sort(np.concatenate([h[ok] for h, ok in zip(t.hash, t.within, strict=True)]) >> np.uint64(64 - bits)).astype(np.int64)
                    del t
                    if not len(cells):
                        continue
                    first = np.flatnonzero(np.diff(cells, prepend=-1))
                    n = np.minimum(np.diff(np.append(first, len(cells))), least)
                    cells = cells[first]
                    edge = np.append(np.flatnonzero(np.diff(cells >> low, prepend=-1)), len(cells))
                    out = []
                    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        f = int(cells[x]) >> low
                        out.append((chunk, f, cells_packed(cells[x:y], n[x:y], f << low)))
                        if len(out) == 64:
                            yield row_batch(out, _SKETCH)
                            out = []
                    if out:
                        yield row_batch(out, _SKETCH)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(rows, "fragment"):
            f = held[0]["fragment"]
            total = np.zeros(1 << low, np.uint8)
            for r in held:
                cells, n = cells_of(r["data"], 0, True)
                total[cells] = np.minimum(total[cells].astype(np.int32) + n, least)
            out = []
            for r in held:
                cells, _ = cells_of(r["data"], 0, True)
                cells = cells[total[cells] >= least]
                if len(cells):
                    out.append((r["chunk"], f, cells_packed(cells, None, 0)))
            for k in range(0, len(out), 64):
                yield row_batch(out[k : k + 64], _SKETCH)

    n = partitions(chunks.sparkSession)
    sent = chunks.select("chunk").mapInArrow(lean(send), _SKETCH)
    return sent.repartition(n, "fragment").sortWithinPartitions("fragment").mapInArrow(lean(add), _SKETCH)


def candidates(t: Text, frequent: np.ndarray, bits: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int, int]]]:
    """Of a slice: the phrases of two words and more, each once with its size, that may be frequent; and words with their counts.

    A run may be frequent only if the runs inside it may. Phrases are told apart by the numbers of their words, not by hash.
    """
    n = len(t.own)
    number, size = np.zeros(0, np.int64), 0
    maybe = []
    for h, ok in zip(t.hash, t.within, strict=True):
        m = np.zeros(n, bool)
        at = np.flatnonzero(ok if not maybe else ok & maybe[-1] & np.append(maybe[-1][1:], False))
        cells = (h[at] >> np.uint64(64 - bits)).astype(np.int64)
        k = np.minimum(np.searchsorted(frequent, cells), len(frequent) - 1)
        m[at[frequent[k] == cells]] = True
        maybe.append(m)
    first, number = distinct_within(t.data, t.words, np.zeros(n, np.int64), t.own)
    size, counted = len(first), np.bincount(number, minlength=len(first))
    words = [(t.phrase(k, 1), 1, c) for k, c in zip(first.tolist(), counted.tolist(), strict=True) if maybe[0][k]]
    phrases, prefix = [], number
    for k in range(2, LONGEST + 1):
        at = np.flatnonzero(maybe[k - 1])
        _, once, own = np.unique(prefix[at] * size + number[at + k - 1], return_index=True, return_inverse=True)
        phrases += [(t.phrase(x, k), k) for x in at[once].tolist()]
        prefix = np.full(n, -1, np.int64)
        prefix[at] = own
    return phrases, words


def scanned(text: str, phrases: list[tuple[bytes, int]]) -> np.ndarray:
    """How often each phrase occurs in a plain text, overlaps included."""
    counts = np.zeros(len(phrases), np.int64)
    for a in range(0, len(phrases), PATTERNS):
        automaton = ahocorasick.Automaton()
        for k, (p, _) in enumerate(phrases[a : a + PATTERNS]):
            automaton.add_word(f" {p.decode()} ", k)
        automaton.make_automaton()
        found = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int32)
        some = np.bincount(found, minlength=min(PATTERNS, len(phrases) - a))
        counts[a : a + len(some)] += some
    return counts


_SHARES = "share int, lang string, data binary"
_COUNTS = "lang string, phrase string, k int, n long"


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, n): the exact count of every run of k words, one to four, that occurs `least` times or more in its language; and
    for k = 0 a language's words."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chunks = chunked(asked, scratch(spark, "collocations"), CHUNK)
    n_bytes = int(chunks.agg(F.sum("n_bytes")).first()[0] or 0)
    bits, low = sketch_bits(n_bytes)
    shares = max(16, min(1 << 30, n_bytes // SHARE))

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(rows, "chunk"):
            some = [cells_of(r["data"], r["fragment"] << low, False)[0] for r in held if r["data"]]
            frequent = np.unique(np.concatenate(some)) if some else np.full(1, -1, np.int64)
            chunk = held[0]["chunk"]
            held.clear()
            total: Counter[tuple[str, bytes]] = Counter()
            for lang, s in by_lang(read_chunk(chunk)):
                t = Text(lang, s)
                total[lang, b""] += len(t.own)
                phrases, words = candidates(t, frequent, bits)
                del t
                for p, _, n in words:
                    total[lang, p] += n
                if phrases:
                    for (p, _), n in zip(phrases, scanned(s.decode(), phrases).tolist(), strict=True):
                        total[lang, p] += n
            parts: dict[tuple[str, int], list[bytes]] = {}
            for (lang, p), n in sorted(total.items()):
                parts.setdefault((lang, crc32(p) % shares), []).append(b"%b\t%d" % (p, n))
            total.clear()
            out = [(share, lang, packed(b"\n".join(lines))) for (lang, share), lines in parts.items()]
            for k in range(0, len(out), 64):
                yield row_batch(out[k : k + 64], _SHARES)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(rows, "share"):
            total: dict[str, dict[bytes, int]] = {}
            for r in held:
                own = total.setdefault(r["lang"], {})
                for line in unpacked(r["data"]).split(b"\n"):
                    p, _, n = line.rpartition(b"\t")
                    own[p] = own.get(p, 0) + int(n)
            held.clear()
            out = [(lang, p.decode(), p.count(b" ") + 1 if p else 0, n) for lang, own in total.items() for p, n in own.items() if n >= least or not p]
            for k in range(0, len(out), 20_000):
                yield row_batch(out[k : k + 20_000], _COUNTS)

    every = chunks.select("chunk", F.lit(-1).cast("long").alias("fragment"), F.lit(b"").alias("data"))
    told = upper_bounds(chunks, least, bits, low).unionByName(every).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "fragment")
    sent = told.mapInArrow(lean(scan), _SHARES).repartition(partitions(spark), "share").sortWithinPartitions("share")
    return sent.mapInArrow(lean(add), _COUNTS)


def scored(f: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate at its lowest cut; f as `counted` has it."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), F.array_join(F.slice(words, F.lit(1), c), " ").alias("head"), F.array_join(F.slice(words, c + 1, F.col("k") - c), " ").alias("tail")))
    both = lambda x: F.array(F.struct(x["cut"].alias("cut"), F.lit(True).alias("first"), x["head"].alias("part")), F.struct(x["cut"].alias("cut"), F.lit(False).alias("first"), x["tail"].alias("part")))
    c = f.where("k >= 2").select("lang", "phrase", F.col("n").alias("a"), F.explode(F.flatten(F.transform(cuts, both))).alias("x")).select("lang", "phrase", "a", "x.*")
    parts = f.where(f"k BETWEEN 1 AND {LONGEST - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    each = c.join(parts, ["lang", "part"]).groupBy("lang", "phrase")
    side = lambda k, first: F.max(F.when((F.col("cut") == k) & (F.col("first") == first), F.col("f")))
    got = each.agg(F.first("a").alias("a"), *(side(k, x).alias(f"{'l' if x else 'r'}{k}") for k in range(1, LONGEST) for x in (True, False)))
    at = lambda k: F.expr(f"(CAST(2000000 AS DECIMAL(38, 0)) * a) DIV (CAST(l{k} AS DECIMAL(38, 0)) + r{k})")
    low = F.array_min(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(at(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST))))
    return got.withColumn("x", low).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def covering(f: DataFrame) -> DataFrame:
    """(lang, phrase, longest): for each phrase inside a longer candidate, the largest count of those."""
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: F.array_join(F.slice(words, s, m), " ")))
    )
    return f.where("k > 2").select("lang", F.col("n"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` collocations by score, count and phrase."""
    f = stored(counted(docs, least), "phrases")
    kept = scored(f).join(covering(f), ["lang", "phrase"], "left").where("longest IS NULL OR 100 * CAST(longest AS DECIMAL(38, 0)) < 80 * CAST(a AS DECIMAL(38, 0))").drop("longest")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(f.where("k = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
