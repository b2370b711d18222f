"""Deterministic sharded WARC writer, and the reader.

Records are sorted by page_id over ranges that histograms of the ids fix (the same input gives the same files), each range
is written to files that roll once their compressed size passes a limit, headers and digests are made anew from the payload,
and each record is a gzip member of its own. A file is written under a temporary name, moved to its name when whole, and counts
only if the manifest, a table that Spark commits, lists it: a lost task's second run writes the same bytes again.

Records with equal payloads of at least MIN_REVISIT bytes: the one with the smallest page_id is `response`, the others are
`revisit` records, which carry the HTTP header but no payload.

Null html: empty payload. Null url: no target line. Null page_id: no id line, sorted first, always a response, and never one that
others refer to. Rows that repeat the smallest page_id are all responses. Extra columns are ignored. Empty table: no file.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import lean, make_dir, scratch, store_of

MIN_REVISIT = 100
#: Compressed bytes after which a file rolls, and raw bytes of a range.
ROLL = 32_000_000
RANGE = 16_000_000
BINS = 4096
SPLIT = 64
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long, crc32 long, first_id long, last_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first) of the pages that revisit another; payloads are hashed where they are read and not shuffled."""
    p = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest"))
    copies = p.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    return p.join(copies, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()


def cuts(pages: DataFrame, range_bytes: int) -> list[int]:
    """First ids of the ranges after the first: neighbouring ids up to range_bytes, or up to a BINS-th of all where that is more.

    Histograms find them: bins of equal width, and again within each bin that holds too much, until a bin is one id. So a few ids far from
    the others cost a round and no skew. Bins that hold too much number BINS at most; their parts reach the driver, SPLIT for each.
    """
    sized = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 400).cast("long").alias("size"))
    low, high, total = sized.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    if low is None:
        return []
    most = max(range_bytes, -(-total // BINS))
    whole: list[tuple[int, int]] = []  # first id and size of bins that are small enough, or one id
    heavy, parts = [(low, high)], BINS
    while heavy:
        width = [(h - lo) // parts + 1 for lo, h in heavy]
        first = F.array(*(F.lit(lo) for lo, _ in heavy))
        at = _upto(F.col("id"), [lo for lo, _ in heavy])
        inside = sized.withColumn("bin", (at - 1).cast("int")).where(F.col("bin") >= 0).where(F.col("id") <= F.array(*(F.lit(h) for _, h in heavy))[F.col("bin")])
        offset = F.col("id").cast("decimal(20,0)") - first[F.col("bin")].cast("decimal(20,0)")
        inside = inside.withColumn("part", F.floor(offset / F.array(*(F.lit(w).cast("decimal(20,0)") for w in width))[F.col("bin")]).cast("int"))
        again = []
        for k, j, size in inside.groupBy("bin", "part").agg(F.sum("size")).collect():
            lo = heavy[k][0] + j * width[k]
            if size > most and width[k] > 1:
                again.append((lo, min(heavy[k][1], lo + width[k] - 1)))
            else:
                whole.append((lo, size))
        heavy, parts = sorted(again), SPLIT
    out, held = [], 0
    for lo, size in sorted(whole):
        if held and held + size > most:
            out.append(lo)
            held = 0
        held += size
    return out


def _upto(x: Column, rising: list[int]) -> Column:
    """How many of the rising values are x or less, in two steps of about the root of their number."""
    step = max(1, math.isqrt(len(rising)))
    every = F.array(*(F.lit(v).cast("long") for v in rising))
    heads = F.array(*(F.lit(v).cast("long") for v in rising[::step]))
    k = F.size(F.filter(heads, lambda v: v <= x))
    return F.when(k > 0, (k - 1) * step + F.size(F.filter(F.slice(every, F.greatest((k - 1) * step + 1, F.lit(1)), step), lambda v: v <= x))).otherwise(0)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{_name(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{_name(first, digest)}>", f"X-Refers-To-Page-ID: {first}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{digest}")


def member(raw: bytes) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, folder: str, name: str):
        self.store, self.folder = store_of(folder)
        self.uri, self.name, self.temp = f"{folder}/{name}", name, f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temp)
        self.n, self.size, self.crc, self.first, self.last = 0, 0, 0, None, None

    def add(self, page_id: int | None, data: bytes) -> None:
        self.out.write(data)
        self.first = page_id if self.n == 0 else self.first
        self.n, self.size, self.crc, self.last = self.n + 1, self.size + len(data), zlib.crc32(data, self.crc), page_id

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.store.move(self.temp, f"{self.folder}/{self.name}")
        return pa.RecordBatch.from_pylist([{"path": self.uri, "n_records": self.n, "n_bytes": self.size, "crc32": self.crc, "first_id": self.first, "last_id": self.last}], pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("n_records", "n_bytes", "crc32", "first_id", "last_id"))]))


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, range_bytes: int = RANGE) -> DataFrame:
    """Write the archives below `folder` and return the committed manifest."""
    spark = pages.sparkSession
    cut = cuts(pages, range_bytes)
    files = f"{folder}/archives"
    make_dir(spark, files)
    part = F.coalesce(_upto(F.col("page_id"), cut), F.lit(0)) if cut else F.lit(0)
    # A page's marks come before the page: both go to the range of its id.
    laid = pages.select(F.lit(1).alias("kind"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    laid = laid.unionByName(revisits(pages).select(F.lit(0).alias("kind"), "page_id", "digest", "first"), allowMissingColumns=True)
    laid = laid.repartitionById(len(cut) + 1, part.cast("int")).sortWithinPartitions("page_id", "kind", "html", "url")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, own, marks, marked = TaskContext.get().partitionId(), 0, None, {}, None
        for b in rows:
            for kind, page_id, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in ("kind", "page_id", "url", "html", "digest", "first")), strict=True):
                if page_id != marked:
                    marks, marked = {}, page_id
                if kind == 0:
                    marks[digest] = first
                    continue
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                if own is None:
                    own = _File(files, f"range-{at:06d}-{k:05d}.warc.gz")
                own.add(page_id, member(record(page_id, url, payload, digest, marks.get(digest))))
                if own.size >= roll:
                    yield own.close()
                    own, k = None, k + 1
        if own is not None:
            yield own.close()

    laid.select("kind", "page_id", "url", "html", "digest", "first").mapInArrow(lean(write), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one by one."""
    z, held = zlib.decompressobj(31), []
    while data := stream.read(piece):
        while data:
            held.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(held)
                z, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Fields and block of a record; the digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("a record is damaged")
    return fields, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives that the manifest lists."""
    n = max(1, min(manifest.count(), 100_000))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for uri in b.column("path").to_pylist():
                store, path = store_of(uri)
                out = []
                with store.open_input_stream(path, compression=None) as f:
                    for raw in members(f):
                        fields, block = parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError("a payload is damaged")
                        to, own, url = fields.get("X-Refers-To-Page-ID"), fields.get("X-Page-ID"), fields.get("WARC-Target-URI")
                        out.append((own and int(own), url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), size, digest, kind, to and int(to)))
                        if len(out) >= 5000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    # files are named by range and number: hashed to the nearest of n parts they would bunch, dealt in order they don't
    place = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("path"))
    dealt = manifest.select("path", F.pmod(place * 64 + F.pmod(F.xxhash64("path"), F.lit(64)), F.lit(n)).cast("int").alias("part"))
    return dealt.repartitionById(n, F.col("part")).select("path").mapInArrow(lean(read), RECORD)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in RECORD.split(", ")])


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write and read back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder))



