"""Loss and rank reports, latency and playback statistics, loudness, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loss_report(probs: DataFrame, targets: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """by, forced, model_token, rank and cross_entropy per step and channel.

    rank: how many codes are more probable than the forced one (ties by code), -1 if it is not among them;
    cross_entropy: -ln p of the forced token, null where the forced token is ignored (-100) or absent.
    """
    best = probs.groupBy(*by).agg(F.max_by(code, F.struct(F.col("p"), -F.col(code))).alias("model_token"))
    chosen = targets.join(probs.select(*by, F.col(code).alias("forced"), F.col("p").alias("_p")), [*by, "forced"], "left")
    ahead = (
        chosen.select(*by, "forced", "_p")
        .join(probs.select(*by, F.col(code).alias("_c"), F.col("p").alias("_q")), by)
        .groupBy(*by, "forced")
        .agg(F.count_if((F.col("_q") > F.col("_p")) | ((F.col("_q") == F.col("_p")) & (F.col("_c") < F.col("forced")))).alias("_n"))
    )
    out = chosen.join(best, by).join(ahead, [*by, "forced"], "left")
    rank = F.when(F.col("_p").isNull(), F.lit(-1)).otherwise(F.col("_n")).cast("bigint")
    ce = F.when((F.col("forced") != -100) & (F.col("_p") > 0), -F.log("_p"))
    return out.select(*by, "forced", "model_token", rank.alias("rank"), ce.alias("cross_entropy"))


def corrected_ema(rows: DataFrame, by: list[str], pos: str, value: str, beta: float = 0.85) -> DataFrame:
    """Bias-corrected moving average after each value.

    sum_i (1-beta) beta^(n-i) x_i / sum_i (1-beta) beta^(n-i). Values older than `reach` steps weigh less than
    1e-15 of the newest, so the frame is bounded and a stream's length does not matter.
    """
    import math

    reach = math.ceil(math.log(1e-16) / math.log(beta))
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(-reach, 0)
    values = F.collect_list(F.col(value).cast("double")).over(w)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    step = lambda a, x: F.struct((a["s"] * beta + (1 - beta) * x).alias("s"), (a["n"] * beta + (1 - beta)).alias("n"))
    return rows.withColumn("ema", F.aggregate(values, start, step, lambda a: a["s"] / a["n"]))


def intensity(bins: Column, low: float = 0.0, high: float = 255.0, levels: int = 10) -> tuple[Column, Column]:
    """RMS of spectrum bins, and its level from 0 to `levels`."""
    value = F.sqrt(F.avg(bins * bins))
    return value, F.floor(F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * levels)


def sessions(rows: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """(by, start, end, n): runs of rows whose gaps are below `gap`."""
    return (
        rows.groupBy(*by, F.session_window(ts, gap).alias("_w"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
        .drop("_w")
    )


def rms_db(square_mean: Column) -> Column:
    """Level in dB of a mean square, with the floor that gates silence."""
    return F.when(square_mean > 0, 10 * F.log10(square_mean) - 0.691).otherwise(F.lit(-70.0))


def gain_to(level: Column, target: float = -24.0) -> Column:
    return F.pow(F.lit(10.0), (target - level) / 20)


def message_counts(messages: DataFrame, by: list[str]) -> DataFrame:
    return messages.groupBy(*by).agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("audio", "text", "control", "metadata", "error", "ping")])
