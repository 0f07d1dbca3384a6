"""Sliding, convolution-style and context windows over a stream's positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Dense positions from 0 within each stream."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def causal_conv(rows: DataFrame, by: list[str], pos: str, value: str, weights: list[float], stride: int = 1, dilation: int = 1, bias: float = 0.0) -> DataFrame:
    """(by, frame, y): weighted sums of k taps, with a left pad of (k-1)*dilation - (stride-1) zeros.

    Output f reads the inputs up to f*stride + stride - 1; missing ones at the right count as zero.
    """
    reach = (len(weights) - 1) * dilation
    w = Window.partitionBy(*by).orderBy(pos)
    base = stride - 1 - reach
    y = F.lit(bias)
    for i, weight in enumerate(weights):
        off = base + i * dilation
        tap = F.lead(value, off, 0.0).over(w) if off >= 0 else F.lag(value, -off, 0.0).over(w)
        y = y + weight * tap
    out = rows.withColumn("y", y).where(F.col(pos) % stride == 0)
    return out.select(*by, F.floor(F.col(pos) / stride).alias("frame"), "y")


def valid_conv(rows: DataFrame, by: list[str], pos: str, value: str, weights: list[float], stride: int = 1) -> DataFrame:
    """(by, frame, y) without padding: floor((n - k) / stride) + 1 frames, as a streaming convolution emits."""
    w = Window.partitionBy(*by).orderBy(pos)
    y = F.lit(0.0)
    for i, weight in enumerate(weights):
        y = y + weight * (F.lead(value, i).over(w) if i else F.col(value))
    out = rows.withColumn("y", y).where((F.col(pos) % stride == 0) & F.col("y").isNotNull())
    return out.select(*by, F.floor(F.col(pos) / stride).alias("frame"), "y")


def overlap_add(rows: DataFrame, by: list[str], pos: str, value: str, weights: list[float], stride: int, normalise: bool = False, trim: int = 0) -> DataFrame:
    """(by, t, y): transposed convolution. Every input adds to k outputs; optionally divided by the overlap count.

    trim outputs at the end of each stream are left out.
    """
    taps = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(float(x)).alias("w")) for i, x in enumerate(weights)])
    spread = rows.select(*by, F.col(pos).alias("_p"), F.col(value).alias("_x"), F.explode(taps).alias("tap"))
    spread = spread.select(*by, (F.col("_p") * stride + F.col("tap.i")).alias("t"), (F.col("_x") * F.col("tap.w")).alias("_y"))
    y = F.sum("_y") / F.count("*") if normalise else F.sum("_y")
    out = spread.groupBy(*by, "t").agg(y.alias("y"))
    if trim:
        last = rows.groupBy(*by).agg((F.max(pos) * stride + len(weights) - trim).alias("_stop"))
        out = out.join(last, by).where("t < _stop").drop("_stop")
    return out


def downsample(rows: DataFrame, by: list[str], pos: str, value: str, stride: int) -> DataFrame:
    """Box filter of 2*stride taps."""
    return causal_conv(rows, by, pos, value, [1 / (2 * stride)] * (2 * stride), stride)


def upsample(rows: DataFrame, by: list[str], pos: str, value: str, stride: int) -> DataFrame:
    """Overlap-add of 2*stride ones, divided by the overlap count."""
    return overlap_add(rows, by, pos, value, [1.0] * (2 * stride), stride, normalise=True)


def interpolate(rows: DataFrame, by: list[str], pos: str, value: str, times: int) -> DataFrame:
    """Linear interpolation between neighbours, `times` values per input; the last is held."""
    w = Window.partitionBy(*by).orderBy(pos)
    after = F.coalesce(F.lead(value).over(w), F.col(value))
    fine = rows.withColumn("_n", after).select(*by, F.col(pos).alias("_p"), F.col(value).alias("_x"), "_n", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_i"))
    return fine.select(*by, (F.col("_p") * times + F.col("_i")).alias("t"), (F.col("_x") + (F.col("_n") - F.col("_x")) * F.col("_i") / times).alias("y"))


def ring_context(rows: DataFrame, by: list[str], pos: str, context: int, strict: bool = False, **aggs: Column) -> DataFrame:
    """Aggregates over the last `context` positions; strict: one less, as a full ring masks its oldest slot."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(-(context - (2 if strict else 1)), 0)
    return rows.withColumns({name: a.over(w) for name, a in aggs.items()})


def attention_pool(rows: DataFrame, by: list[str], pos: str, query: str, key: str, value: str, context: int, scale: float = 1.0) -> DataFrame:
    """(by, pos, pooled): softmax(query * key * scale) weighted mean of the values in the causal context.

    One window by range of positions: the rows are shuffled and sorted once, and none is copied for each of the
    `context` positions that see it. Positions are integers.
    """
    w = Window.partitionBy(*by).orderBy(F.col(pos).cast("bigint")).rangeBetween(-(context - 1), 0)
    seen = rows.select(*by, pos, F.col(query).alias("_q"), F.collect_list(F.struct(F.col(key).alias("_k"), F.col(value).alias("_v"))).over(w).alias("_l"))
    scored = seen.withColumn("_s", F.transform("_l", lambda x: F.struct((F.col("_q") * x["_k"] * scale).alias("_s"), x["_v"].alias("_v"))))
    scored = scored.withColumn("_m", F.array_max(F.transform("_s", lambda x: x["_s"])))
    weight = lambda x: F.exp(x["_s"] - F.col("_m"))
    num = F.aggregate("_s", F.lit(0.0), lambda a, x: a + weight(x) * x["_v"])
    den = F.aggregate("_s", F.lit(0.0), lambda a, x: a + weight(x))
    return scored.select(*by, pos, (num / den).alias("pooled"))


def per_step_weights(rows: DataFrame, weights: DataFrame, pos: str, value: str) -> DataFrame:
    """Multiply by a weight that depends on the step; steps beyond the table take its last row."""
    last = weights.agg(F.max("step").alias("_last"))
    keyed = rows.crossJoin(F.broadcast(last)).withColumn("step", F.least(F.col(pos), F.col("_last")))  # one row
    return keyed.join(weights, "step").withColumn("y", F.col(value) * F.col("weight")).drop("_last")
