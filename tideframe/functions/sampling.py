"""Choosing tokens from logits: softmax, greedy, top-k, nucleus and reproducible draws.

A logit table has one row per (step, code). Draws use an exponential race: the code with the largest
p / -ln(u) wins, which chooses each code with its probability. u comes from md5 of the row's key and a
seed, so results do not depend on partitioning and can be repeated in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of md5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") + 1) / F.lit(4294967297.0)


def softmax(logits: DataFrame, by: list[str], logit: str = "logit", temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*by)
    z = F.col(logit) / temperature
    e = F.exp(z - F.max(z).over(w))
    return logits.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def greedy(logits: DataFrame, by: list[str], code: str = "code", logit: str = "logit") -> DataFrame:
    """The code of the largest logit; ties to the smallest code. A plain aggregate, combined before the shuffle."""
    return logits.groupBy(*by).agg(F.max_by(code, F.struct(F.col(logit), -F.col(code))).alias("token"))


def top_k(probs: DataFrame, by: list[str], k: int, code: str = "code") -> DataFrame:
    """The k most probable codes of each step (all, if fewer)."""
    w = Window.partitionBy(*by).orderBy(F.desc("p"), code)
    return probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_p(probs: DataFrame, by: list[str], p: float, code: str = "code") -> DataFrame:
    """The nucleus: codes whose more probable ones sum to at most p; p is normalised again."""
    w = Window.partitionBy(*by).orderBy(F.desc("p"), code).rowsBetween(Window.unboundedPreceding, 0)
    kept = probs.withColumn("before", F.sum("p").over(w) - F.col("p")).where(F.col("before") <= p)
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*by))).drop("before")


def draw(probs: DataFrame, by: list[str], key: Column, code: str = "code") -> DataFrame:
    """One code per step by the exponential race."""
    score = F.col("p") / -F.log(uniform(key))
    return probs.withColumn("score", score).groupBy(*by).agg(F.max_by(code, F.struct("score", -F.col(code))).alias("token"))


def sample(
    logits: DataFrame,
    by: list[str],
    key: Column,
    use_sampling: bool = True,
    temperature: float = 1.0,
    k: int = 0,
    p: float = 0.0,
    code: str = "code",
) -> DataFrame:
    """Greedy without sampling or temperature; else nucleus before top-k before the full distribution."""
    if not use_sampling or temperature <= 0:
        return greedy(logits, by, code)
    probs = softmax(logits, by, temperature=temperature)
    if p > 0:
        probs = top_p(probs, by, p, code)
    elif k > 0:
        probs = top_k(probs, by, k, code)
    return draw(probs, by, key, code)


def sample_rows(rows: DataFrame, n: int, key: Column, total: int) -> DataFrame:
    """n rows in the order of a hash: without replacement if there are enough, else with."""
    if total >= n:
        return rows.orderBy(F.md5(key.cast("string")), key).limit(n)
    from pyspark.sql import Window as W

    numbered = rows.withColumn("_n", F.row_number().over(W.orderBy(key)) - 1)  # fewer rows than n
    picks = rows.sparkSession.range(n).withColumn("_n", F.floor(uniform(F.col("id")) * total).cast("int")).drop("id")
    return picks.join(numbered, "_n").drop("_n")
