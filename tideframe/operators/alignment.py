"""Channels that carry different delays: delaying, undoing it, aligning streams, and overlaying tokens.

All work on long rows (stream keys, channel, step, token). A shift by a delay is an equi-join on the
shifted step in effect; as steps are dense within a channel it is written with lag and lead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def channels(spark, delays: list[int] = C.DELAYS) -> DataFrame:
    """The channel dimension: k, stream, delay."""
    rows = [(k, "text" if k == 0 else "agent" if k <= 8 else "user", d) for k, d in enumerate(delays)]
    return spark.createDataFrame(rows, "k int, stream string, delay int")


def delay(rows: DataFrame, by: list[str], step: str, value: str, delay_steps: int, fill: Column) -> DataFrame:
    """Shift a channel to later steps; the first steps get the fill value."""
    w = Window.partitionBy(*by).orderBy(step)
    if delay_steps == 0:
        return rows.withColumn("delayed", F.col(value))
    late = F.row_number().over(w) > delay_steps
    return rows.withColumn("delayed", F.when(late, F.lag(value, delay_steps).over(w)).otherwise(fill))


def undelay(rows: DataFrame, by: list[str], step: str, value: str, delay_steps: int, fill: Column) -> DataFrame:
    """Shift a channel back; the last steps get the fill value and are not valid."""
    w = Window.partitionBy(*by).orderBy(step)
    if delay_steps == 0:
        return rows.withColumns({"undelayed": F.col(value), "valid": F.lit(True)})
    valid = F.lead(F.lit(True), delay_steps, False).over(w)
    return rows.withColumn("valid", valid).withColumn("undelayed", F.when(F.col("valid"), F.lead(value, delay_steps).over(w)).otherwise(fill))


def shift_to_grid(tokens: DataFrame, dimension: DataFrame, step: str = "step") -> DataFrame:
    """Put each token at its step plus its channel's delay."""
    return tokens.join(dimension.select("k", "delay"), "k").withColumn(step, F.col(step) + F.col("delay")).drop("delay")


def gather(tokens: DataFrame, dimension: DataFrame, step: str = "step") -> DataFrame:
    """Take each channel's token from its delayed place; warm-up steps have none."""
    return tokens.join(dimension.select("k", "delay"), "k").withColumn(step, F.col(step) - F.col("delay")).drop("delay").where(F.col(step) >= 0)


def align_streams(sides: dict[str, DataFrame], by: list[str], index: str) -> DataFrame:
    """Full outer join of streams on their position; a column per stream."""
    out = None
    for name, rows in sides.items():
        side = rows.select(*by, index, F.col("value").alias(name))
        out = side if out is None else out.join(side, [*by, index], "full_outer")
    return out


def common_prefix(a: DataFrame, b: DataFrame, by: list[str], index: str) -> DataFrame:
    """Element-wise sum of two streams as far as both have come."""
    joined = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), [*by, index])
    return joined.select(*by, index, (F.col("_a") + F.col("_b")).alias("value"))


def overlay(provided: Column, target: Column, sampled: Column) -> Column:
    """Teacher forcing: a provided token wins over a sampled one."""
    return F.when(provided, target).otherwise(sampled)


def loss_mask(valid: Column, code: Column) -> Column:
    return valid & (code != C.ZERO_TOKEN)


def after_warm_up(rows: DataFrame, step: str, max_delay: int) -> DataFrame:
    return rows.where(F.col(step) > max_delay)


def with_start(rows: DataFrame, by: list[str], step: str, value: str, start: Column) -> DataFrame:
    """Put a start token before each stream and drop its last step."""
    w = Window.partitionBy(*by).orderBy(step)
    return rows.withColumn(value, F.coalesce(F.lag(value).over(w), start))


def initial_tokens(spark) -> DataFrame:
    """The column before the first step: text start, then audio start on every audio channel."""
    text = spark.createDataFrame([(0, C.TEXT_START)], "k int, token int")
    audio = spark.range(1, len(C.DELAYS)).select(F.col("id").cast("int").alias("k"), F.lit(C.BINS).alias("token"))
    return text.unionAll(audio)


def check_tokens(rows: DataFrame, cardinality: int) -> DataFrame:
    """Raise if a token is ungenerated or outside of its vocabulary."""
    fine = (F.col("token") != C.UNGENERATED) & (F.col("token") <= cardinality) & (F.col("token") >= C.ZERO_TOKEN)
    return rows.withColumn("_ok", F.assert_true(fine, "token outside of its vocabulary")).where("_ok is null").drop("_ok")


def embed(tokens: DataFrame, table: DataFrame, by: list[str], dim: int) -> DataFrame:
    """Sum over channels of embedding rows: -1 gives zeros, other negative ids row 0."""
    key = tokens.withColumn("_row", F.greatest(F.col("token"), F.lit(0))).withColumn("_zero", F.col("token") == C.ZERO_TOKEN)
    joined = key.join(table.select("k", F.col("token").alias("_row"), "vector"), ["k", "_row"], "left")
    sums = [F.sum(F.when(F.col("_zero"), 0.0).otherwise(F.get("vector", F.lit(i)))).alias(f"_d{i}") for i in range(dim)]
    return joined.groupBy(*by).agg(*sums).select(*by, F.array(*[F.col(f"_d{i}") for i in range(dim)]).alias("embedding"))


def prompt_program(phases: list[DataFrame], by: list[str]) -> DataFrame:
    """Phases (by, phase_step, ...) one after another, numbered through as `step`."""
    out = None
    for n, phase in enumerate(phases):
        rows = phase.withColumn("phase", F.lit(n).cast("bigint"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("phase", "phase_step")
    return out.withColumn("step", (F.row_number().over(w) - 1).cast("bigint"))


def generate(sampled: DataFrame, provided: DataFrame, dimension: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, step, token): what a generator gives out for tokens sampled on the delayed grid.

    sampled: (by, k, step, token) on the grid. provided: (by, k, step, token) before delays; they win over the
    sampled ones. Steps up to the largest delay give nothing, and every channel is read at its delayed place.
    """
    forced = shift_to_grid(provided, dimension).select(*by, "k", "step", F.col("token").alias("_given"))
    joined = sampled.join(forced, [*by, "k", "step"], "full_outer")
    chosen = joined.select(*by, "k", "step", overlay(F.col("_given").isNotNull(), F.col("_given"), F.col("token")).alias("token"))
    return gather(chosen, dimension).select(*by, "k", "step", "token")
