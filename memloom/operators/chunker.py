"""Cutting documents into overlapping chunks at sentence ends: a fold along the text, so a table function over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 500, 50
#: Separators in the order in which they are tried.
SEPARATORS = ("。", "！", "？", "，", "、", "\n", ". ", "? ", "! ")


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Windows of `size` characters, each cut behind its last separator of the first kind that it holds past the overlap.

    The next window starts `overlap` before the cut. A cut within the overlap would give the same window again, so it is none.
    """
    if len(text) <= size:
        if text.strip():
            yield text
        return
    text, start = text.strip(), 0
    while start < len(text):
        end = start + size
        if end < len(text):
            found = next((at for at in (text.rfind(s, start, end) for s in SEPARATORS) if at > start + overlap), None)
            end = end if found is None else found + 1
        piece = text[start:end].strip()
        if piece:
            yield piece
        if end >= len(text):
            return
        start = end - overlap


def chunked(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, content) of each document; null text gives none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(chunks(t or "", size, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field(0).type), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], [key, "chunk_index", "content"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, content string")


def windows(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, content) by plain windows, within the JVM."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    d = docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return d.select(key, "chunk_index", F.substr(text, F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))
