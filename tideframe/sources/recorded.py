"""Recorded message streams as a Spark data source, for batch and for streaming, and as a sink.

    spark.dataSource.register(RecordedMessages)
    spark.read.format("recorded_messages").load(folder)
    spark.readStream.format("recorded_messages").option("files_per_batch", 10).load(folder)

A file `<session>.msg` holds, for each message: 8 bytes receive time (microseconds), 4 bytes length, and the
message, whose first byte is its kind (little-endian). A file is one partition. The folder is reached through
pyarrow, so it may be local or in any store that pyarrow knows.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

HEAD = "<qI"
HEAD_SIZE = struct.calcsize(HEAD)
SCHEMA = "session_id string, ts timestamp, message binary"
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _open(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def list_files(folder: str) -> list[str]:
    from pyarrow import fs

    store, base = _open(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".msg"))


def parse(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(microseconds, message); a record that is cut off at the end has not been written yet and is left out."""
    at = 0
    while at + HEAD_SIZE <= len(data):
        ts, n = struct.unpack_from(HEAD, data, at)
        at += HEAD_SIZE
        if at + n > len(data):
            return
        yield ts, data[at : at + n]
        at += n


def read_file(folder: str, name: str) -> Iterator[tuple[str, datetime.datetime, bytes]]:
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/{name}") as f:
        data = f.read()
    session = name.removesuffix(".msg").partition("~")[0]
    for ts, message in parse(data):
        yield session, EPOCH + datetime.timedelta(microseconds=ts), message


@dataclass
class OneFile(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [OneFile(n) for n in list_files(self.folder)] or [OneFile("")]

    def read(self, partition):
        return read_file(self.folder, partition.name) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are names: all files up to and including that name have been read."""

    def __init__(self, folder: str, per_batch: int):
        self.folder = folder
        self.per_batch = per_batch
        self.at: str | None = None

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        names = [n for n in list_files(self.folder) if self.at is None or n > self.at]
        if names:
            self.at = names[: self.per_batch][-1]
        return {"last": self.at or ""}

    def partitions(self, start, end):
        names = [n for n in list_files(self.folder) if start["last"] < n <= end["last"]]
        return [OneFile(n) for n in names]

    def read(self, partition):
        return read_file(self.folder, partition.name)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """One file per session and task, under a name of its own until it is complete."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        store, base = _open(self.folder)
        store.create_dir(base, recursive=True)
        parts: dict[str, list[bytes]] = {}
        for row in iterator:
            ts = row["ts"] if row["ts"].tzinfo else row["ts"].astimezone(datetime.timezone.utc)
            micros = (ts - EPOCH) // datetime.timedelta(microseconds=1)
            message = bytes(row["message"])
            parts.setdefault(str(row["session_id"]), []).append(struct.pack(HEAD, micros, len(message)) + message)
        names = []
        for session, rows in parts.items():
            name = f"{session}~{uuid.uuid4().hex}.msg"
            with store.open_output_stream(f"{base}/{name}.writing") as f:
                f.write(b"".join(rows))
            names.append(name)
        return Written(names)

    def commit(self, messages):
        store, base = _open(self.folder)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{base}/{name}.writing", f"{base}/{name}")

    def abort(self, messages):
        store, base = _open(self.folder)
        for m in messages:
            for name in m.names if m else ():
                store.delete_file(f"{base}/{name}.writing")


class RecordedMessages(DataSource):
    @classmethod
    def name(cls):
        return "recorded_messages"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType):
        return _StreamReader(self.options["path"], int(self.options.get("files_per_batch", "100")))

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options["path"])
