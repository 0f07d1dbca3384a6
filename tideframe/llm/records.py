"""Token ids in length-delimited binary records with masked checksums, and an offset index beside them.

A record file holds, for each sequence: 8 bytes length, 4 bytes masked checksum of the length, the
payload, 4 bytes masked checksum of the payload (all little-endian). A payload is one byte of id width,
one byte that tells whether there is a document id, the document id, and the token ids. A checksum is
CRC-32 rotated right by 15 bits plus a constant, so that files that hold checksums do not check against
themselves. The index file holds per record its offset, the payload's length and the number of tokens,
which lets a reader fetch records in any order.

Files are written by range of document id, so that the files in order, and the records in a file, ascend.
Every attempt of a task writes files of its own name, which nothing renames or overwrites; the manifest names those of
the attempt that Spark accepted, so lost, repeated and concurrent attempts leave at most files that nothing reads.

Defined cases: null text counts as empty; a null id is kept and comes first; rows that repeat an id
follow each other in an order fixed by their text; an empty table gives no records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, narrow, prepare, scratch, texts_of
from .tokens import word_encoder

#: Fixed value: what the mask adds to the rotated checksum.
MASK_ADD = 0xA282EAD8
_HEAD, _TAIL, _OWNER = "<QI", "<I", "<BBq"
HEAD_SIZE, TAIL_SIZE, OWNER_SIZE = (struct.calcsize(x) for x in (_HEAD, _TAIL, _OWNER))
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])


class TornRecord(ValueError):
    """A length or a payload does not match its checksum."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack(_TAIL, masked(size)), payload, struct.pack(_TAIL, masked(payload))))


def payload_of(owner: int | None, ids: np.ndarray) -> bytes:
    return struct.pack(_OWNER, ids.dtype.itemsize, owner is not None, owner or 0) + ids.tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, owner = struct.unpack_from(_OWNER, payload)
    return owner if known else None, np.frombuffer(payload, f"<u{width}", offset=OWNER_SIZE)


def _one(read) -> bytes | None:
    head = read(HEAD_SIZE)
    if not head:
        return None
    if len(head) < HEAD_SIZE:
        raise TornRecord("a length is cut off")
    size, check = struct.unpack(_HEAD, head)
    if masked(head[:8]) != check:
        raise TornRecord("a length does not match its checksum")
    payload, tail = read(size), read(TAIL_SIZE)
    if len(payload) < size or len(tail) < TAIL_SIZE or masked(payload) != struct.unpack(_TAIL, tail)[0]:
        raise TornRecord("a payload does not match its checksum")
    return payload


def read_records(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a file in order, checked."""
    fs, name = filesystem(path)
    with fs.open_input_stream(name, buffer_size=1 << 20) as f:
        while (payload := _one(f.read)) is not None:
            yield parse(payload)


def read_index(path: str) -> np.ndarray:
    fs, name = filesystem(path)
    with fs.open_input_stream(name) as f:
        return np.frombuffer(f.read(), _INDEX)


def read_shuffled(path: str, seed: int = 0) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a file in a random order, each fetched by its place in the index."""
    index = read_index(path + ".idx")
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        for k in np.random.default_rng(seed).permutation(len(index)):
            f.seek(int(index[k]["offset"]))
            yield parse(_one(f.read))


def write_records(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
) -> list[dict]:
    """Encode and write all documents; returns the manifest, one entry per file in order of id.

    The manifest is as long as the number of partitions of the shuffle by range, whatever the data's size.
    """
    prepare(docs.sparkSession)
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    source = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        where, root = filesystem(folder)
        name = f"records-{part:06d}-{uuid.uuid4().hex}.bin"
        own = f"{root}/{name}"
        rows: list[tuple[int, int, int]] = []
        offset = 0
        out = None
        for b in batches:
            if out is None:
                out = where.open_output_stream(own, buffer_size=1 << 20)
            for owner, data in zip(b.column(0).to_pylist(), encoder.encode(texts_of(b.column(1))), strict=True):
                ids = np.append(np.frombuffer(data, encoder.dtype), np.array([end_id], encoder.dtype))
                payload = payload_of(owner, ids)
                out.write(frame(payload))
                rows.append((offset, len(payload), len(ids)))
                offset += len(payload) + HEAD_SIZE + TAIL_SIZE
        if out is None:
            return
        out.close()
        with where.open_output_stream(own + ".idx") as f:
            f.write(np.array(rows, _INDEX).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([sum(r[2] for r in rows)], pa.int64())],
            ["part", "name", "records", "tokens"],
        )

    done = ranged.mapInArrow(write, "part int, name string, records bigint, tokens bigint").collect()
    first, out = 0, []
    for r in sorted(done, key=lambda r: r["part"]):
        out.append({"path": f"{folder}/{r['name']}", "first": first, "records": r["records"], "tokens": r["tokens"]})
        first += r["tokens"]
    return out


def scan_records(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers), read back from the files."""
    prepare(spark)
    schema = "path string, first bigint"
    files = spark.createDataFrame([(m["path"], m["first"]) for m in manifest], schema)
    if manifest:
        files = files.repartition(len(manifest), F.hash("path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for owner, ids in read_records(path):
                    rows.append((owner, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 8192:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def new_folder(spark: SparkSession) -> str:
    return scratch(spark, "records")
