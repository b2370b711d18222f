"""Token-ID files: documents encoded, an end id after each, coded by the context-mixing range coder.

A file holds documents in ascending doc_id order (null first, equal ids by text) and files follow each other in that order:

    magic, header length (u32), header (JSON: counts, block size, bits of an id, index CRC-32), index, block table, blocks

The index has doc_id, validity and number of ids of each document, deflated; the table has bytes and CRC-32 of each block.
Blocks are coded independently, so any can be read by itself, and a damaged one is told by its checksum.

A text is cut into pre-tokens where it is read (kernels.split); the tokenizers library encodes each pre-token of a task's dictionary once, and
a document's ids are gathered from these codes. Ids go to the coder and come from it in blocks, in the same task. Files get a unique
name and count only if the committed manifest lists them, so a lost task's second run leaves no trace in the output.

Null text: empty, the end id alone. Repeated rows are documents of their own. Extra columns are ignored. Empty table: no file.
A very long text is one row; its ids leave in blocks. Memory is bounded by FILE_IDS, the kernel's
dictionary (600,000 words) and one text.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import kernels, range_coder, splitter
from memloom.llm.common import by_parts, lean, make_dir, plan_bytes, running_totals, scratch, slices, small_batches, store_of, stored
from memloom.llm.token_counts import Pieces, pieces

MAGIC = b"MLTOKEN2"
END = 2
#: Bytes of the table's files in a range of documents, and ids in a file.
RANGE = 24_000_000
FILE_IDS = 6_000_000
#: Bytes of cut texts gathered at once.
SLICE = 4_000_000
MANIFEST = "seq long, path string, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: kind 0: blocks of n and m ids; kind 1: the file's index, n its ids, first (when reading) or last (when writing) of the file's rows.
_BLOCKS = "seq long, kind int, n int, m int, bits int, data binary, more binary"
_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]
_CODED = ("data", "n", "more", "m", "bits")


class Codes:
    """The ids of the words of a task's dictionary, end to end."""

    def __init__(self, cut: Pieces, kind: str):
        self.cut, self.kind = cut, kind
        self._clear(None)

    def _clear(self, dictionary: int | None) -> None:
        self.dictionary, self.n = dictionary, 0
        self.flat, self.ends = np.zeros(1 << 16, self.kind), np.zeros((1 << 16) + 1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        flat, sizes = self.cut.ids(words)
        ends = self.ends[self.n] + np.cumsum(sizes)
        m = self.n + len(words)
        if m >= len(self.ends):
            self.ends = np.r_[self.ends, np.zeros(max(m, len(self.ends)), np.int64)]
        while ends[-1] > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), self.kind)]
        self.flat[self.ends[self.n] : ends[-1]] = flat
        self.ends[self.n + 1 : m + 1] = ends
        self.n = m

    def ids(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of cut texts end to end, and how many each has."""
        flats, counts, at, words = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], [], []
        n = self.n

        def gather() -> None:
            """The ids of the texts so far: those of one dictionary."""
            nonlocal at, words
            if words:
                self._learn(words)
            if at:
                flat = np.concatenate(at)
                begins = self.ends[flat]
                sizes = self.ends[flat + 1] - begins
                ends = np.cumsum(sizes)
                places = np.arange(int(ends[-1]) if len(ends) else 0)
                places += np.repeat(begins - ends + sizes, sizes)
                flats.append(self.flat[places])
                counts.append(np.diff(np.r_[0, ends][np.cumsum([0, *map(len, at)])]))
            at, words = [], []

        for c in cuts:
            (dictionary, before), fresh, places = splitter.unpacked(c)
            if dictionary != self.dictionary:
                gather()
                self._clear(dictionary)
                n = 0
            if before != n:
                raise RuntimeError("cut texts came out of order")
            n += len(fresh)
            words += fresh
            at.append(places)
        gather()
        return np.concatenate(flats), np.concatenate(counts)


def cut_texts(spark: SparkSession, path: str, text: Column) -> Column:
    """The texts cut into pre-tokens by the kernel, the texts of a task with one dictionary."""
    return kernels.split(spark, text, splitter.packed(), sorted(pieces(path).special), remembers=True)


def index_bytes(ids: list[int | None], counts: np.ndarray) -> bytes:
    """The index of a file, deflated."""
    return zlib.compress(np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is not None for i in ids], "u1").tobytes() + counts.astype("<i8").tobytes())


def read_index(index: bytes) -> tuple[list[int | None], np.ndarray]:
    raw = zlib.decompress(index)
    n = len(raw) // 17
    valid = np.frombuffer(raw, "u1", n, 8 * n).astype(bool).tolist()
    return [i if v else None for i, v in zip(np.frombuffer(raw, "<i8", n).tolist(), valid, strict=True)], np.frombuffer(raw, "<i8", n, 9 * n)


def file_bytes(index: bytes, n_ids: int, bits: int, blocks: list[bytes]) -> bytes:
    """A file of the format above; all blocks but the last have BLOCK ids."""
    header = json.dumps({"ids": n_ids, "bits": bits, "block": range_coder.BLOCK, "blocks": len(blocks), "index": len(index), "index_crc32": zlib.crc32(index)}).encode()
    table = b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks)
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, index, table, *blocks])


def read_file(data: bytes) -> tuple[dict, bytes, list[bytes]]:
    """Header, index and blocks of a file; every checksum is checked."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 12 + struct.unpack_from("<I", data, 8)[0]
    h = json.loads(data[12:at])
    index = data[at : at + h["index"]]
    if zlib.crc32(index) != h["index_crc32"]:
        raise ValueError("the index is damaged")
    at += h["index"]
    body, blocks = at + 8 * h["blocks"], []
    for k in range(h["blocks"]):
        size, crc = struct.unpack_from("<II", data, at + 8 * k)
        blocks.append(data[body : body + size])
        body += size
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {k} is damaged")
    return h, index, blocks


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _NAMES)


def _pair(seq: int, own: list[np.ndarray], bits: int) -> tuple:
    raw = [x.tobytes() for x in own]
    return seq, 0, len(own[0]), len(own[1]) if raw[1:] else 0, bits, raw[0], raw[1] if raw[1:] else None


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = END) -> DataFrame:
    """Write the files below `folder`; the committed manifest, `seq` giving the files' order."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = by_parts(plan_bytes(docs), RANGE, 1)
    make_dir(spark, folder)
    bits = range_coder.bits_of(max(pieces(path).size, end + 1))
    kind = range_coder.kind(bits)

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents to blocks of ids, each file's index after its blocks."""
        table, block = Codes(pieces(path), kind), range_coder.BLOCK
        seq = TaskContext.get().partitionId() << 24
        ids, counts, held, n = [], [], np.zeros(0, kind), 0

        def blocks(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            stop = len(held) if whole else len(held) // (2 * block) * 2 * block
            own = [held[x : min(x + block, stop)] for x in range(0, stop, block)]
            for a in range(0, len(own), 32):
                yield _rows([_pair(seq, own[k : k + 2], bits) for k in range(a, min(a + 32, len(own)), 2)])
            n, held = n + stop, held[stop:]

        def index() -> pa.RecordBatch:
            return _rows([(seq, 1, n, 0, bits, index_bytes(ids, np.concatenate(counts)), None)])

        for b in rows:
            cuts, own = b.column("cut"), b.column("doc_id").to_pylist()
            sizes = np.fromiter((len(x.as_buffer()) for x in cuts), np.int64, len(cuts))
            for x, y in slices(sizes, SLICE):
                flat, k = table.ids(cuts[x:y].to_pylist())
                ids += own[x:y]
                counts.append(k + 1)
                held = np.concatenate([held, np.insert(flat, np.cumsum(k), end)])
                yield from blocks(False)
                if n >= FILE_IDS:
                    yield from blocks(True)
                    yield index()
                    seq, ids, counts, n = seq + 1, [], [], 0
        if ids:
            yield from blocks(True)
            yield index()

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, blocks = store_of(folder), []
        for b in rows:
            for seq, kind, n, m, data in zip(*(b.column(k).to_pylist() for k in ("seq", "kind", "n", "m", "data")), strict=True):
                if kind == 0:
                    blocks += range_coder.apart(data)[: 1 + (m > 0)]
                    continue
                name, made = f"{uuid.uuid4().hex}.tokens", file_bytes(data, n, bits, blocks)
                with store[0].open_output_stream(f"{store[1]}/{name}") as f:
                    f.write(made)
                docs_in = len(zlib.decompress(data)) // 17
                yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int64()), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([docs_in], pa.int64()), "n_ids": pa.array([n], pa.int64()), "n_bytes": pa.array([len(made)], pa.int64())})
                blocks = []

    laid = docs.repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    cut = laid.select("doc_id", cut_texts(spark, path, F.col("text")).alias("cut"))
    blocks = cut.mapInArrow(lean(gather), _BLOCKS)
    code = F.when(F.col("kind") == 0, range_coder.coded(spark, *map(F.col, _CODED))).otherwise(F.col("data"))
    return stored(blocks.withColumn("data", code).drop("more").mapInArrow(lean(write), MANIFEST), "manifest")


def _opened(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to rows, each file's index before its blocks."""
    for b in rows:
        for seq, uri in zip(b.column("seq").to_pylist(), b.column("path").to_pylist(), strict=True):
            store, path = store_of(uri)
            with store.open_input_file(path) as f:
                h, index, blocks = read_file(f.read())
            yield _rows([(seq, 1, h["ids"], 0, h["bits"], index, None)])
            sizes = [min(h["block"], h["ids"] - k * h["block"]) for k in range(len(blocks))] + [0]
            blocks.append(None)
            for a in range(0, len(blocks) - 1, 32):
                yield _rows([(seq, 0, sizes[k], sizes[k + 1], h["bits"], blocks[k], blocks[k + 1]) for k in range(a, min(a + 32, len(blocks) - 1), 2)])


def _ids(files: DataFrame) -> DataFrame:
    """Rows of _opened, the blocks decoded."""
    spark = files.sparkSession
    rows = files.mapInArrow(lean(_opened), _BLOCKS)
    return rows.withColumn("data", F.when(F.col("kind") == 0, range_coder.decoded(spark, *map(F.col, _CODED))).otherwise(F.col("data"))).drop("more")


def _documents(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """seq, and some documents' doc_ids, counts and ids at a time, in order."""
    ids, counts, held, at, seq = [], np.zeros(0, np.int64), b"", 0, 0
    for b in rows:
        for own, kind, bits, data in zip(*(b.column(k).to_pylist() for k in ("seq", "kind", "bits")), b.column("data"), strict=True):
            if kind:
                seq, (ids, counts), at, held = own, read_index(data.as_py()), 0, []
                ends = np.cumsum(counts)
                done = 0
                continue
            held.append(np.frombuffer(data.as_buffer()[4:], range_coder.kind(bits)))  # the two blocks follow each other
            done += len(held[-1])
            to = int(np.searchsorted(ends, done, "right"))
            if to > at:
                flat = np.concatenate(held)
                n = int(counts[at:to].sum())
                yield seq, ids[at:to], counts[at:to], flat[:n]
                held, at = [flat[n:]], to


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Each document of the files in the manifest: where its ids start, how many there are, and the CRC-32 of their bytes."""
    starts = running_totals(manifest, "seq", "n_ids", F.expr("shiftright(seq, 36)"))
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    parts = max(1, min(n, 100_000))
    files = manifest.join(starts, "seq").repartitionById(parts, F.least(F.expr(f"cast(before * {parts}D / {max(1, size)} as int)"), F.lit(parts - 1)))
    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for start, ids, counts, flat in _documents(rows):
            if start != now:
                now = at = start
            raw = memoryview(flat.astype("<u4").tobytes())
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends - counts + at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], [x.split()[0] for x in DOCUMENTS.split(", ")])
            at += int(ends[-1])

    # the place of a file's first id travels as its seq
    return _ids(files.select(F.col("before").alias("seq"), "path")).mapInArrow(lean(read), DOCUMENTS)


def tokens_of(manifest: DataFrame) -> DataFrame:
    """doc_id and ids of each document of the files, for users of the files."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, counts, tokens in _documents(rows):
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(tokens.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat], ["doc_id", "ids"])

    return _ids(manifest.select("seq", "path")).mapInArrow(lean(read), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write and read back."""
    return read_tokens(write_tokens(docs, path, folder or scratch(docs.sparkSession, "tokens")))
