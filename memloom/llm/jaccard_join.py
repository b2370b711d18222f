"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

A document's set is its distinct n-grams of lower-cased (A-Z) words; with fewer words, the whole sequence is its one element.
Equal sets are one node, so that copies cost nothing. Sets are held as 64-bit hashes.

1. The global n-gram order is frequency class first (the power of two below the number of sets that hold an n-gram), then hash. Chunks send
   their distinct n-grams (32 bits of hash within a fragment of the hash range) with counts; fragments answer with classes.
2. A set of which more than 1 - t is in no other set can link to none and goes. Of the others, any two that link share an
   element of their prefixes, the first n - ceil(t n) + 1 elements in the global order. Prefix elements lead, through components
   of the graph set - element, to clusters: sets that link lie in one cluster.
3. Clusters are cut into blocks of bounded size. A set goes to a pair of blocks only if it shares a prefix element with a set of the other
   block: candidates come from shared elements, a frequent element being split by blocks, and sets that a cluster merely chains
   together never meet. For each pair of blocks the global order is cut into FRAGMENTS; each fragment
   counts its partial overlaps of all pairs by itself, and the counts are summed per pair. |A n B| / |A u B| then follows with
   the sets' sizes. A pair of blocks reports a spanning forest of its links, not the links.

A group of g sets that all share an element costs g^2 / 2 sums in blocks, in as many tasks; no block is larger than BLOCK sets or BLOCK_GRAMS
n-grams, or one set. Sets are told apart by 128 bits: a node is 64 of them, and sets that agree in these alone get new nodes.

Null or empty text: empty set, linked with nothing, its component is its own doc_id. Null doc_id: never a component's name unless it
has no other. Rows that repeat an id and a text are one node. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.chunks import CHUNK, chunked, groups, part_of, read_chunk, row_batch
from memloom.llm.common import by_parts, lean, partitions, scratch, slices, small_batches, stored
from memloom.llm.components import components

FRAGMENTS = 4
BLOCK = 384
BLOCK_GRAMS = 400_000
#: Words kept with their hashes in a worker.
MEMORY = 200_000
_LAST = (1 << 63) - 1
#: Characters of text cut into words at once.
SLICE = 2_000_000

_SENT = "frag int, chunk string, n int, low binary, counts binary"
_CLASSES = "frag int, chunk string, classes binary"
#: grams and prefix (little-endian 64-bit hashes) are null where the set links to nothing, or the chunk has it already.
_SETS = "doc_id long, chunk string, row int, node long, more long, n long, prefix binary, grams binary"
_SEGMENTS = "cluster long, one int, two int, frag int, node long, side int, n long, grams binary"
_PARTIAL = "cluster long, one int, two int, frag int, nodes binary, sizes binary, rows int, at binary, counts binary"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _Words()


def gram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    each = [t.encode().lower().split() for t in texts]
    flat = np.fromiter((_WORDS[w] for e in each for w in e), np.uint64, sum(map(len, each)))
    grams = flat[: max(0, len(flat) - words + 1)].copy()
    for k in range(1, words):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
        grams += flat[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    out, at = [], 0
    for e in each:
        if len(e) >= words:
            out.append(np.unique(grams[at : at + len(e) - words + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b"\xff".join(e), len(e))] if e else [], np.uint64))
        at += len(e)
    return out


class _Chunk:
    """A chunk's sets, with the first row of each distinct one."""

    def __init__(self, uri: str, words: int):
        rows = read_chunk(uri)
        self.ids = rows.column("doc_id").cast(pa.int64()).combine_chunks()
        self.sets, texts = [], rows.column("text")
        for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), SLICE):
            self.sets += gram_sets([t or "" for t in texts[a:b].to_pylist()], words)
        whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in self.sets]
        self.nodes, self.more = (np.fromiter((x >> k & (1 << 64) - 1 for x in whole), np.uint64, len(whole)).view(np.int64) for k in (64, 0))
        known: dict[int, int] = {}
        for i, (x, s) in enumerate(zip(whole, self.sets, strict=True)):
            if len(s):
                known.setdefault(x, i)
        self.firsts = sorted(known.values())

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams in rising order of hash, and how many distinct sets have them."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(self.sets[i] for i in self.firsts)]), return_counts=True)


def _send(words: int, parts: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for uri in b.column("chunk").to_pylist():
                h, n = _Chunk(uri, words).grams()
                cut = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
                low, n = (h & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(n, 255).astype("u1")
                yield row_batch([(f, uri, int(y - x), low[x:y].tobytes(), n[x:y].tobytes()) for f, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x or f == 0], _SENT)

    return run


def _classes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in groups(rows, "frag"):
        low = [np.frombuffer(r.pop("low"), "<u4") for r in own]
        ends = np.cumsum([0, *map(len, low)])
        # the n-gram in the high bits, its place in the low ones: one sort without a second array of places
        both = np.concatenate(low).astype(np.uint64) << np.uint64(32) | np.arange(ends[-1], dtype=np.uint64)
        both.sort()
        place = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        both >>= np.uint64(32)
        begins = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        counts = np.concatenate([np.frombuffer(r.pop("counts"), "u1") for r in own])[place].astype(np.uint32)
        sums = np.add.reduceat(counts, begins) if len(both) else counts
        found = np.empty(len(both), "u1")
        found[place] = np.repeat(np.log2(np.maximum(sums, 1)).astype("u1"), np.diff(np.r_[begins, len(both)]))
        yield row_batch([(r["frag"], r["chunk"], found[x:y].tobytes()) for r, x, y in zip(own, ends, ends[1:], strict=False)], _CLASSES)


def _sets(words: int, num: int, den: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(rows, "chunk"):
            own.sort(key=lambda r: r["frag"])
            c = _Chunk(own[0]["chunk"], words)
            h, _ = c.grams()
            classes = np.concatenate([np.frombuffer(r["classes"], "u1") for r in own])
            prefix: list[bytes | None] = [None] * len(c.sets)
            grams: list[bytes | None] = [None] * len(c.sets)
            for i in c.firsts:
                s = c.sets[i]
                k = classes[np.searchsorted(h, s)]
                alone = int((k == 0).sum())
                if den * (len(s) - alone) >= num * len(s):
                    length = len(s) - -(-num * len(s) // den) + 1
                    prefix[i] = s[np.lexsort((s, k))[alone:length]].tobytes()
                    grams[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([c.ids, pa.array([own[0]["chunk"]] * len(c.sets), pa.string()), pa.array(range(len(c.sets)), pa.int32()), pa.array(c.nodes, pa.int64()), pa.array(c.more, pa.int64()), pa.array([len(s) for s in c.sets], pa.int64()), pa.array(prefix, pa.binary()), pa.array(grams, pa.binary())], [x.split()[0] for x in _SETS.split(", ")])

    return run


def _explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        parts = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *parts])), pa.array(np.repeat(np.asarray(b.column("node")), [len(p) for p in parts]))], ["gram", "node"])


def _segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's fragments for its block by itself and with each block that it shares a prefix element with."""
    for b in rows:
        out, held = [], 0
        for r in b.to_pylist():
            s = np.frombuffer(r["grams"], np.uint64)
            cut = np.searchsorted(part_of(s, FRAGMENTS), np.arange(FRAGMENTS + 1))
            for other in {r["block"], *(r["others"] or ())}:
                one, two = sorted((r["block"], other))
                for f in range(FRAGMENTS):
                    seg = s[cut[f] : cut[f + 1]].tobytes()
                    out.append((r["cluster"], one, two, f, r["node"], int(r["block"] == two and one != two), r["n"], seg))
                    held += len(seg)
                if held > 8_000_000:
                    yield row_batch(out, _SEGMENTS)
                    out, held = [], 0
        yield row_batch(out, _SEGMENTS)


def overlaps(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first `rows` sets with the rest, or of all with all if there is no rest.

    Elements that stand in one set only are left out; the others are columns of 0/1 matrices, multiplied slice by slice.
    """
    m = len(sets)
    one, two = (slice(0, m), slice(0, m)) if rows == m else (slice(0, rows), slice(rows, m))
    out = np.zeros((one.stop - one.start, two.stop - two.start), np.float32)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    keep = n > 1
    new = np.cumsum(keep) - 1
    sel = keep[col]
    who, col = who[sel], new[col[sel]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    total = int(keep.sum())
    width = min(max(1, total), max(1, 4_000_000 // max(1, m)))
    for a in range(0, total, width):
        x, y = np.searchsorted(col, (a, a + width))
        t = np.zeros((m, width), np.float32)
        t[who[x:y], col[x:y] - a] = 1
        out += t[one] @ t[two].T
    return out


def keyed(rows: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Sorted rows, one list for each combination of the keys."""
    held: list[dict] = []
    for b in rows:
        for r in b.to_pylist():
            if held and any(r[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in keyed(rows, ("cluster", "one", "two", "frag")):
        n = sum(r["side"] == 0 for r in own)
        if n == 0 or (own[0]["one"] != own[0]["two"] and n == len(own)):
            continue
        o = overlaps([np.frombuffer(r["grams"], np.uint64) for r in own], n)
        at = np.flatnonzero(o)
        first = own[0]
        yield row_batch([(first["cluster"], first["one"], first["two"], first["frag"], np.array([r["node"] for r in own]).tobytes(), np.array([r["n"] for r in own]).tobytes(), n, at.astype("<u4").tobytes(), o.ravel()[at].astype("<u4").tobytes())], _PARTIAL)


def _links(num: int, den: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in keyed(rows, ("cluster", "one", "two")):
            nodes, sizes, n = np.frombuffer(own[0]["nodes"], np.int64), np.frombuffer(own[0]["sizes"], np.int64), own[0]["rows"]
            m = len(nodes)
            base = 0 if n == m else n
            both = np.zeros(n * (m - base), np.int64)
            for r in own:
                both[np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["counts"], "<u4")
            i, j = np.divmod(np.flatnonzero(both), m - base)
            c, j = both[both > 0], j + base
            hit = (den * c >= num * (sizes[i] + sizes[j] - c)) & (i < j)
            root = list(range(m))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            forest = []
            for a, b in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                p, q = find(a), find(b)
                if p != q:
                    root[p] = q
                    forest.append((int(nodes[a]), int(nodes[b])))
            yield row_batch(forest, "a long, b long")

    return run


def linked(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs.

    Two sets link when den * |A n B| >= num * |A u B|.
    """
    rows = _linked(_chunks(docs.select("doc_id", "text")), words, num, den)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _chunks(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return chunked(docs, scratch(docs.sparkSession, "texts"), CHUNK)


def _linked(chunks: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Each row of the chunks: doc_id, chunk, row, n, and for sets with elements root (the component's node) and component_id."""
    width = partitions(chunks.sparkSession)
    n, size = chunks.selectExpr("count(*)", "coalesce(sum(n_bytes), 0)").first()
    parts = by_parts(int(size), 2 * CHUNK, 8)
    classes = chunks.select("chunk").repartition(max(1, n)).mapInArrow(lean(_send(words, parts)), _SENT).repartition(width, "frag").sortWithinPartitions("frag", "chunk").mapInArrow(lean(_classes), _CLASSES)
    sets = _told_apart(stored(classes.repartition(width, "chunk").sortWithinPartitions("chunk").mapInArrow(lean(_sets(words, num, den)), _SETS), "sets"))

    pre = sets.where("prefix IS NOT NULL").select("node", "prefix").mapInArrow(lean(_explode), "gram long, node long").where("gram IS NOT NULL")
    stars = stored(pre.distinct(), "prefixes")
    pivots = stars.groupBy("gram").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("gram", "pivot")
    cluster = components(stars.join(pivots, "gram").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    cluster = cluster.withColumnRenamed("root", "cluster")

    one = Window.partitionBy("node").orderBy("doc_id")
    members = sets.where("grams IS NOT NULL").join(cluster, "node").withColumn("k", F.row_number().over(one)).where("k = 1")
    members = stored(members.select("cluster", "node", "n", "grams"), "members")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the other blocks of a set's cluster that hold one of its prefix elements: of an element, blocks are listed, not pairs of sets
    there = stars.join(placed.where("blocks > 1").select("node", "block"), "node")
    held = there.select("gram", F.col("block").alias("other")).distinct()
    others = there.join(held, "gram").where("block <> other").groupBy("node").agg(F.collect_set("other").alias("others"))
    placed = placed.join(others, "node", "left")
    pair = ["cluster", "one", "two"]
    segments = placed.mapInArrow(lean(_segments), _SEGMENTS).repartition(width, *pair, "frag").sortWithinPartitions(*pair, "frag", "side", "node")
    partial = segments.mapInArrow(lean(_partial), _PARTIAL).repartition(width, *pair).sortWithinPartitions(*pair, "frag")
    roots = components(partial.mapInArrow(lean(_links(num, den)), "a long, b long"))

    labels = stored(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("label")), "labels")
    named = roots.join(labels, "node")
    named = named.join(named.groupBy("root").agg(F.min("label").alias("component")), "root").select("node", "root", "component")
    names = labels.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component", "label").alias("component_id"))
    rows = sets.select("doc_id", "chunk", "row", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n")
    return rows.join(stored(names, "names"), "node", "left")


def _told_apart(sets: DataFrame) -> DataFrame:
    """sets, with new nodes for those that share a node but not the other 64 bits; at 10^10 sets there are a few."""
    shared = sets.where("n > 0").groupBy("node").agg(F.min("more").alias("low"), F.max("more").alias("high")).where("low < high").select("node", F.lit(True).alias("shared"))
    shared = stored(shared, "shared")
    if shared.isEmpty():
        return sets.drop("more")
    own = F.when(F.col("shared"), F.xxhash64("node", "more")).otherwise(F.col("node"))
    return sets.join(shared, "node", "left").withColumn("node", own).drop("shared", "more")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays (null last, then any one).

    Of rows without words one stays for each doc_id. The rows are read from the chunks; no text is shuffled.
    """
    schema, chunks = docs.schema, _chunks(docs)
    rows = _linked(chunks, words, num, den)
    group = F.struct(F.col("root").alias("root"), F.when(F.col("n") == 0, F.coalesce("doc_id", F.lit(_LAST))).alias("lone"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "chunk", "row"))
    kept = rows.groupBy(group.alias("g")).agg(first.alias("r")).select("r.chunk", "r.row")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, "chunk"):
            yield from read_chunk(own[0]["chunk"]).take(pa.array([r["row"] for r in own])).to_batches()

    return kept.repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "row").mapInArrow(lean(take), schema)
