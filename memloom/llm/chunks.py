"""Documents as chunk files in the shared folder, and what passes over chunks have in common.

A chunk is read by name as often as needed, so that a pass that needs texts again shuffles none, and a lost task reads the same
documents in the same order. Only chunks that the committed table lists count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from memloom.llm.common import lean, make_dir, slices, store_of, stored

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK = 8_000_000


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of the hash a value lies in; rising with it."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def chunked(docs: DataFrame, folder: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write documents as chunk files below folder; (chunk, n_bytes) of those that the committed table lists."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        held, size = [], 0

        def put() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(f"{path}/{name}") as f:
                pq.write_table(pa.Table.from_batches(held), f, compression="zstd")
            return pa.RecordBatch.from_pydict({"chunk": pa.array([f"{folder}/{name}"]), "n_bytes": pa.array([size], pa.int64())})

        for b in rows:
            sizes = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)).astype(np.int64)
            for x, y in slices(sizes, max(1, chunk_bytes // 4)):
                held.append(b.slice(x, y - x))
                size += int(sizes[x:y].sum())
                if size >= chunk_bytes:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    spark = docs.sparkSession
    make_dir(spark, folder)
    return stored(docs.mapInArrow(lean(write), "chunk string, n_bytes long"), "chunks")


def groups(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Sorted rows, one list for each key."""
    held: list[dict] = []
    for b in rows:
        for r in b.to_pylist():
            if held and r[key] != held[0][key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def row_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema of simple types."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def read_chunk(uri: str) -> pa.Table:
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        return pq.read_table(f)


def steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, laid end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def packed(raw: bytes) -> bytes:
    """Compressed bytes, led by their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def row_hash(table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    wide = np.zeros((len(table), -(-table.shape[1] // 8) * 8), np.uint8)
    wide[:, : table.shape[1]] = table
    h = np.zeros(len(table), np.uint64)
    for k in range(0, wide.shape[1], 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.ascontiguousarray(wide[:, k : k + 8]).view("<u8").ravel()
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def distinct_rows(table: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows of bytes, in the order of the key if given, and each row's number among them.

    Rows are put side by side by hash and compared byte by byte; a collision could only leave equal rows apart.
    """
    h = row_hash(table)
    order = np.argsort(h, kind="stable") if key is None else np.lexsort((h, key))
    t = table[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]).any(axis=1)
    if key is not None:
        new[1:] |= key[order][1:] != key[order][:-1]
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    return order[new], own


def sorted_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes in lexicographic order, and each row's rank among them."""
    wide = np.zeros((len(table), -(-table.shape[1] // 8) * 8), np.uint8)
    wide[:, : table.shape[1]] = table
    keys = [np.ascontiguousarray(wide[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, wide.shape[1], 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return table[order[new]], rank
