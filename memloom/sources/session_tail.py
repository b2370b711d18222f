"""Growing session files as a stream: each batch has the lines that were appended since the last one.

The offset is the length of each file up to its last line end, so that a line that is being written waits for its end; a last line without an end
counts once it is whole JSON. A file that
became shorter was replaced and is read again. Deleted files are left out. Batches are byte ranges of files, read where the tasks run, through the
file system that the path names; an interrupted batch reads the same ranges again. The offset has an entry for each file: a folder of
live sessions, not an archive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from memloom.sources import sessions

#: Bytes that are looked at in a step backwards to the last line end, and bytes in a partition at least.
STEP = 1 << 16
PART = 1 << 26


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _whole(store: pyarrow.fs.FileSystem, path: str, begin: int, size: int) -> int:
    """The end of the last whole line in [begin, size), or begin."""
    with store.open_input_file(path) as f:
        at = end = size
        while at > begin:
            low = max(begin, at - STEP)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            end = low + found + 1 if found >= 0 else begin
            if found >= 0:
                break
            at = low
        f.seek(end)
        try:
            json.loads(f.read(size - end))
        except ValueError:
            return end
    return size


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, path = _store(self.path)
        files = {}
        for info in store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)):
            if info.type == pyarrow.fs.FileType.File and ".jsonl" in info.base_name:
                files[info.path] = _whole(store, info.path, 0, info.size)
        return {"files": json.dumps(files, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        old, out = json.loads(start["files"]), []
        for path, size in json.loads(end["files"]).items():
            begin = old.get(path, 0)
            if size < begin:
                begin = 0
            if size > begin:
                out.append(Range(path, begin, size))
        return out

    def read(self, part: Range) -> Iterator[tuple[str, str]]:
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as f:
            f.seek(part.begin)
            left, rest = part.end - part.begin, b""
            while left:
                got = f.read(min(left, PART))
                if not got:
                    return  # the file was cut off meanwhile; what replaced it comes with the next offset
                left -= len(got)
                lines = (rest + got).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    yield line.decode("utf-8", "replace").removesuffix("\r"), part.path
        if rest:
            yield rest.decode("utf-8", "replace"), part.path

    def commit(self, end: dict) -> None:
        pass


class SessionTail(DataSource):
    """spark.readStream.format("session_tail").load(path): (value, path)."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(self.options["path"])


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all session files below path, and of what is appended to them later."""
    spark.dataSource.register(SessionTail)
    return sessions.parsed(spark.readStream.format("session_tail").load(path))
