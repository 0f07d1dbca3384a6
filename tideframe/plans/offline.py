"""The offline run as one batch job: recordings to codes and back to recordings, with transcripts.

A recording's first channel is cut into frames; a linear map makes a latent of each frame; residual
codebooks make codes of the latents. Codes are decoded, mapped back to samples, put together and cut to
the input's length. The maps and codebooks are input tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import arrays
from ..operators import framing, layers, quantize
from ..sources import audio


def frames_of(recordings: DataFrame, size: int = C.FRAME_SIZE) -> DataFrame:
    """(path, frame_idx, frame) of the first channel, the last frame filled with silence."""
    first = recordings.where("channel = 0").select("path", F.col("pcm").cast("array<double>").alias("pcm"))
    rows = first.select("path", F.posexplode(framing.frames(F.col("pcm"), size, F.lit(0.0))).alias("frame_idx", "frame"))
    return rows.withColumn("frame_idx", F.col("frame_idx").cast("bigint"))


def encode(recordings: DataFrame, to_latent: np.ndarray, books: list[quantize.Codebook], size: int = C.FRAME_SIZE) -> DataFrame:
    """(path, frame_idx, codes) of every frame."""
    latent = layers.apply_stack(frames_of(recordings, size), layers.Linear(to_latent), "path", "frame_idx", "frame")
    keyed = latent.select(F.struct("path", "frame_idx").alias("at"), "out")
    found = quantize.residual_encode(keyed, books, "at", "out")
    return found.select("at.path", "at.frame_idx", "codes")


def decode(codes: DataFrame, table: DataFrame, to_samples: np.ndarray, dim: int) -> DataFrame:
    """(path, pcm) from codes by level."""
    long = quantize.codes_long(codes.select(F.struct("path", "frame_idx").alias("at"), "codes"), "at")
    latent = quantize.decode(long, table, "at", dim).select("at.path", "at.frame_idx", "decoded")
    samples = layers.apply_stack(latent, layers.Linear(to_samples), "path", "frame_idx", "decoded")
    return framing.join_frames(samples.withColumnRenamed("out", "pcm"), ["path"], "frame_idx", "pcm").withColumnRenamed("samples", "pcm")


def run(recordings: DataFrame, to_latent: np.ndarray, to_samples: np.ndarray, books: list[DataFrame], size: int = C.FRAME_SIZE) -> DataFrame:
    """(path, pcm): the recordings through the codec, as long as they came in."""
    ready = [quantize.Codebook(b) for b in books]
    table = quantize.codebook_table(list(enumerate(books)))
    out = decode(encode(recordings, to_latent, ready, size), table, to_samples, to_latent.shape[0])
    length = recordings.where("channel = 0").select("path", F.size("pcm").alias("_n"))
    return out.join(length, "path").select("path", arrays.fit_length(F.col("pcm"), F.col("_n"), F.lit(0.0)).alias("pcm"))


def write(result: DataFrame, folder: str) -> DataFrame:
    """The result as WAV files named by a digest of their input's path."""
    return audio.write_wavs(result.select(F.md5("path").alias("name"), "pcm"), "name", "pcm", folder)
