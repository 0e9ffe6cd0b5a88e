"""One binary file written by many tasks: rows are bytes and the offset in the file that they belong at.

Each task writes its rows at their places of an unfinished file beside the target (a file system
that all tasks share and that takes writes at any place: a local disk, a mounted share). Its commit
message is as small for a million rows as for one: the bytes written, and the sum of a hash of each
run's start less a hash of its end. The runs of all tasks lie end to end from 0 to the size exactly
if only the hashes of 0 and of the size are left over, and only then is the file renamed to the
target. A failed or repeated attempt of a task writes the same bytes at the same places.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that a task gathers before it writes them.
RUN_BYTES = 8 << 20
SCHEMA = "offset long, data binary"


def local_path(path: str) -> str:
    """The path as the operating system knows it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: bytes can be placed on a mounted file system only")
    return path


def _hash(place: int) -> int:
    return int.from_bytes(hashlib.blake2b(place.to_bytes(16, "little"), digest_size=8).digest(), "little")


@dataclass
class Written(WriterCommitMessage):
    size: int
    ends: int  # hashes of the starts less those of the ends of the runs, mod 2**64


def tiled(messages: list[Written]) -> int:
    """The size of the file, if the runs of all tasks lie end to end from 0."""
    size = sum(m.size for m in messages)
    left = sum(m.ends for m in messages) % (1 << 64)
    if left != (_hash(0) - _hash(size)) % (1 << 64):
        raise ValueError("the rows overlap or leave out bytes of the file")
    return size


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.unfinished = f"{path}.unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        size = ends = 0
        start, run, held = 0, [], 0
        file = os.open(self.unfinished, os.O_WRONLY | os.O_CREAT, 0o644)

        def flush() -> None:
            nonlocal size, ends, run, held
            raw, at = memoryview(b"".join(run)), start
            while raw:
                done = os.pwrite(file, raw, at)
                raw, at = raw[done:], at + done
            if held:
                size += held
                ends += _hash(start) - _hash(start + held)
            run, held = [], 0

        try:
            for b in iterator:
                for offset, data in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = data.as_py()
                    if offset != start + held or held >= RUN_BYTES:
                        flush()
                        start = offset
                    run.append(raw)
                    held += len(raw)
            flush()
            os.fsync(file)
        finally:
            os.close(file)
        return Written(size, ends % (1 << 64))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            size = tiled([m for m in messages if m is not None])
        except ValueError:
            self.abort(messages)
            raise
        file = os.open(self.unfinished, os.O_WRONLY | os.O_CREAT, 0o644)
        os.ftruncate(file, size)
        os.close(file)
        os.replace(self.unfinished, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.unfinished):
            os.remove(self.unfinished)


class PlacedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "karst_placed"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_placed(rows: DataFrame, path: str) -> None:
    """Write rows of SCHEMA as one file; they must cover it from 0 without gaps or overlaps."""
    rows.sparkSession.dataSource.register(PlacedSink)
    rows.select("offset", "data").write.format("karst_placed").mode("overwrite").save(local_path(path))
