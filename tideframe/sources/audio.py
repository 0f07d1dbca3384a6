"""WAV files as tables of samples, and tables as WAV files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (channel, time) as float32 in [-1, 1]."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels, n = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return rate, x.reshape(-1, channels).T


def encode_wav(samples: np.ndarray, rate: int = C.SAMPLE_RATE) -> bytes:
    """Mono, 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear resampling along the last axis."""
    if source == target or x.shape[-1] == 0:
        return x
    n = max(1, round(x.shape[-1] * target / source))
    at = np.arange(n) * (source / target)
    return np.stack([np.interp(at, np.arange(x.shape[-1]), c).astype(np.float32) for c in x])


def read_wav(spark: SparkSession, path: str, rate: int = C.SAMPLE_RATE) -> DataFrame:
    """(path, channel, pcm) of all WAV files under a path, at one rate."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                own, x = decode_wav(data)
                rows += [(p, k, c.tolist()) for k, c in enumerate(resample(x, own, rate))]
            yield pd.DataFrame(rows, columns=["path", "channel", "pcm"])

    return files.mapInPandas(run, "path string, channel int, pcm array<float>")


def wav_bytes(table: DataFrame, key: str, pcm: str, rate: int = C.SAMPLE_RATE) -> DataFrame:
    """(key, content): each row's samples as a WAV file's bytes, ready for any sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "content": [encode_wav(np.asarray(x, np.float32), rate) for x in b[pcm]]})

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, pcm).mapInPandas(run, f"{key} {kind}, content binary")


def transcript_json(pieces: DataFrame, by: list[str], order: str, piece: str) -> DataFrame:
    """The pieces of each session as a JSON array in order."""
    rows = pieces.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, piece))).alias("_p"))
    return rows.select(*by, F.to_json(F.transform("_p", lambda x: x[piece])).alias("value"))


def write_wavs(table: DataFrame, key: str, pcm: str, folder: str, rate: int = C.SAMPLE_RATE) -> DataFrame:
    """Write each row's samples to `<folder>/<key>.wav`; returns (key, path, n_samples) lazily.

    Files appear under their names when they are complete, so a repeated task does no harm.
    """
    import uuid

    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            rows = []
            for k, x in zip(b[key], b[pcm], strict=True):
                own = f"{base}/{uuid.uuid4().hex}.writing"
                with store.open_output_stream(own) as f:
                    f.write(encode_wav(np.asarray(x, np.float32), rate))
                store.move(own, f"{base}/{k}.wav")
                rows.append((k, f"{folder}/{k}.wav", len(x)))
            yield pd.DataFrame(rows, columns=[key, "path", "n_samples"])

    return table.select(key, pcm).mapInPandas(run, f"{key} {kind}, path string, n_samples bigint")
