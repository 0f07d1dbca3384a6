"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent

#: Rows of one Arrow batch that the Python stages get. Documents can be long, so a batch is kept
#: small; what a stage holds is a few batches, whatever the size of the partition.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers of any cluster and bound their batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_tideframe_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="tideframe"))
    target = folder / "tideframe_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(str(target))
    sc._tideframe_shipped = True


_leave: dict[str, list] = {}
_running = ""


def on_leave(kind: str, clear) -> None:
    """Register how to drop what a kind of operator keeps in a Python worker between its tasks."""
    _leave.setdefault(kind, []).append(clear)


def enter(kind: str) -> None:
    """Say which kind of operator a task in this worker runs. Workers are reused: what other kinds have kept is
    dropped and given back to the system, so that a job's stages do not add up in memory."""
    global _running
    if _running == kind:
        return
    for other, clears in _leave.items():
        if other != kind:
            for clear in clears:
                clear()
    if _running:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _running = kind


def narrow(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name under new names, whatever else the table holds.

    The selection goes by position, so extra columns whose names clash with each other or with
    the operators' own names do no harm.
    """
    at = {new: df.columns.index(old) for new, old in wanted.items()}
    return positional(df).select(*[F.col(f"_c{i}").alias(new) for new, i in at.items()])


def positional(df: DataFrame) -> DataFrame:
    """All columns under names of their own, so that clashing ones do no harm; `toDF(*df.columns)` undoes it."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset in local mode (tests) a temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(sc, "_tideframe_shared", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="tideframe_shared")
            sc._tideframe_shared = found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """pyarrow's filesystem and the path in it, for file://, hdfs://, s3:// and plain paths."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def npz(**arrays) -> bytes:
    import numpy as np

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def un_npz(data: bytes) -> dict:
    import numpy as np

    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
