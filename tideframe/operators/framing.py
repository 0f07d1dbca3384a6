"""Fixed-size frames from whole recordings, packets or texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(a: Column, size: int, fill: Column | None = None, max_len: int | None = None) -> Column:
    """Array of arrays of `size` values; the last is filled up unless fill is None. Empty input has no frame."""
    n = F.ceil(F.size(a) / size).cast("int")
    if max_len is not None:
        n = F.least(n, F.lit(max_len))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(index, lambda i: F.slice(a, i * size + 1, F.lit(size)))
    if fill is None:
        return cut
    return F.transform(cut, lambda x: F.concat(x, F.array_repeat(fill, size - F.size(x))))


def text_frames(table: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, frame_idx, frame, n_valid) of every text; the last frame is filled with blanks."""
    n = F.ceil(F.length(text_col) / size).cast("bigint")
    index = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    rows = table.select(id_col, F.col(text_col).alias("_t"), F.explode(index).alias("frame_idx"))
    piece = F.substring(F.col("_t"), (F.col("frame_idx") * size + 1).cast("int"), F.lit(size))
    return rows.select(id_col, "frame_idx", F.rpad(piece, size, " ").alias("frame"), F.length(piece).cast("bigint").alias("n_valid"))


def rechunk(packets: DataFrame, by: list[str], order: list[str], length: Column, size: int) -> DataFrame:
    """Which packets each full frame is made of: by, frame_idx, first and last packet, and how many.

    Lengths are summed up along a stream; frame f covers the positions f*size to (f+1)*size - 1. The
    remainder after the last full frame waits for more packets.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = packets.withColumn("_len", length.cast("bigint"))
    rows = rows.withColumn("_end", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_no", F.row_number().over(w) - 1)
    total = F.sum("_len").over(Window.partitionBy(*by))
    rows = rows.withColumn("_full", F.floor(total / size)).where("_len > 0")
    first = F.floor((F.col("_end") - F.col("_len")) / size)
    last = F.least(F.floor((F.col("_end") - 1) / size), F.col("_full") - 1)
    cover = rows.where(first <= last).withColumn("frame_idx", F.explode(F.sequence(first, last)))
    return cover.groupBy(*by, "frame_idx").agg(
        F.min("_no").cast("bigint").alias("first_packet"), F.max("_no").cast("bigint").alias("last_packet"), F.count("*").alias("n_packets")
    )


def join_frames(table: DataFrame, by: list[str], index: str, frame: str) -> DataFrame:
    """Frames of a stream put together in order."""
    return table.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(index, frame))), lambda x: x[frame])).alias("samples"))


def stereo(left: Column, right: Column) -> Column:
    """Two channels side by side, the shorter filled with silence."""
    return F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: F.struct(F.coalesce(p["l"], F.lit(0.0)).alias("left"), F.coalesce(p["r"], F.lit(0.0)).alias("right")))


def interleave(samples: DataFrame, channels: int, channel: int = 0) -> DataFrame:
    """One channel of interleaved samples (t, value)."""
    return samples.where(F.col("t") % channels == channel).withColumn("t", F.floor(F.col("t") / channels))
