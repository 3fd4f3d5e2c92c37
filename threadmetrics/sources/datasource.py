"""Threads as a Spark data source: ``spark.read.format("threads")``.

The same rows as :mod:`jsonl`, through PySpark's Python data source interface,
so a reader chooses columns of one kind without a scratch table:

* ``option("kind", ...)`` is ``comments`` (default), ``posts`` or ``rejects``;
* files are cut into byte ranges of ``option("splitBytes", ...)``; a task reads
  the lines that begin in its range, in pieces, whatever the file's size;
* rows leave as Arrow batches of at most ``BATCH`` rows.

``df.write.format("threads")`` takes a column ``value`` of finished lines
(one thread each). A task writes a file under a hidden attempt folder; the
commit moves exactly the files of the successful tasks into place, an abort
removes the attempt, so a lost or repeated task leaves no partial or double
lines. ``overwrite`` removes the former files after the new ones are complete.

Files are opened through Arrow's file systems: a local or shared mount, or any
store that Arrow knows by URI. Register with ``register(spark)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from .jsonl import COMMENTS_DDL, POSTS_DDL, REJECTS_DDL, line_rows

BATCH = 10_000
SPLIT_BYTES = 128 << 20
PIECE = 4 << 20
KINDS = {"comments": ("comment", COMMENTS_DDL), "posts": ("post", POSTS_DDL), "rejects": ("reject", REJECTS_DDL)}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _data_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file or of the visible files below a folder."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
    shown = [f for f in found if f.is_file and not any(p[:1] in "._" for p in f.path[len(at):].split("/") if p)]
    return sorted((f.path, f.size) for f in shown)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def lines_of(source, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin at a byte in [start, end); the last is read to its end."""
    at = max(0, start - 1)            # a line begins at ``start`` if the byte before ends one
    source.seek(at)
    skip, tail, tail_at = start > 0, [], at
    while True:
        piece = source.read(PIECE)
        last, i = not piece, 0
        while i < len(piece):
            j = piece.find(b"\n", i)
            tail.append(piece[i:] if j < 0 else piece[i:j])
            if j < 0:
                break
            if skip:
                skip = False
            else:
                yield b"".join(tail)
            tail, tail_at, i = [], at + j + 1, j + 1
            if tail_at >= end:
                return
        at += len(piece)
        if last:
            if tail and not skip and tail_at < end:
                yield b"".join(tail)
            return


class ThreadsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "comments")
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(name, at, min(at + self.split, size)) for name, size in _data_files(self.path)
                for at in range(0, size, self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        kind, ddl = KINDS[self.kind]
        fields = [f.split() for f in ddl.split(", ")]
        schema = pa.schema([(name, _ARROW[t]) for name, t in fields])
        if not partition.path:
            return
        rows: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n, _ in fields} for r in rows], schema=schema)
        with _store(self.path)[0].open_input_file(partition.path) as source:
            for line in lines_of(source, partition.start, partition.end):
                text = line.decode("utf-8", "replace")
                if not text.strip(" "):
                    continue
                for row in line_rows(text.removesuffix("\r")):
                    if row["kind"] == kind:
                        rows.append(row)
                        if len(rows) >= BATCH:
                            yield batch()
                            rows = []
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ThreadsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.attempt = f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.path)
        name, out = f"part-{uuid.uuid4().hex}.jsonl", None       # every attempt of a task has its own
        for piece in iterator:
            lines = [v for v in piece.column("value").to_pylist() if v is not None]
            if lines and out is None:
                store.create_dir(f"{at}/{self.attempt}", recursive=True)
                out = store.open_output_stream(f"{at}/{self.attempt}/{name}")
            for line in lines:
                if "\n" in line:
                    raise ValueError("a thread is one line")
                out.write(line.encode() + b"\n")
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        old = [name for name, _ in _data_files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                store.move(f"{at}/{self.attempt}/{m.name}", f"{at}/{m.name}")
        for name in old:
            store.delete_file(name)
        self._forget()

    def abort(self, messages: list[Written | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        store, at = _store(self.path)
        if store.get_file_info(f"{at}/{self.attempt}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/{self.attempt}")


class ThreadsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "threads"

    def schema(self) -> str:
        kind = self.options.get("kind", "comments")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return KINDS[kind][1]

    def reader(self, schema) -> ThreadsReader:
        return ThreadsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ThreadsWriter:
        if [f.name for f in schema.fields] != ["value"]:
            raise ValueError("threads are written from one column, value")
        return ThreadsWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ThreadsSource)
