"""Structured Streaming forms of the stateful operators. Each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from .jitter import JitterBuffer


def rechunk_stream(packets: DataFrame, key: str, order: str, text: str, size: int) -> DataFrame:
    """Full frames of `size` characters of each stream's concatenated packets; the remainder is the state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(parts)).sort_values(order)
        rest += "".join(rows[text])
        out = []
        full = len(rest) // size
        for i in range(full):
            out.append((k[0], n + i, rest[i * size : (i + 1) * size]))
        state.update((rest[full * size :], n + full))
        yield pd.DataFrame(out, columns=[key, "frame_idx", "frame"])

    kind = packets.schema[key].dataType.simpleString()
    return packets.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame_idx bigint, frame string", "rest string, n bigint", "append", GroupStateTimeout.NoTimeout
    )


def ema_stream(values: DataFrame, key: str, order: str, value: str, beta: float = 0.85) -> DataFrame:
    """The bias-corrected moving average after each value."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, n = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for at, x in zip(rows[order], rows[value], strict=True):
            s, n = s * beta + (1 - beta) * float(x), n * beta + (1 - beta)
            out.append((k[0], at, s / n))
        state.update((s, n))
        yield pd.DataFrame(out, columns=[key, order, "ema"])

    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    return values.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double", "s double, n double", "append", GroupStateTimeout.NoTimeout
    )


def delay_stream(tokens: DataFrame, delays: list[int] = C.DELAYS) -> DataFrame:
    """Put (session, k, step, token) rows on the delayed grid; stateless, as the shift is known per channel."""
    by = F.array(*[F.lit(d) for d in delays])
    return tokens.withColumn("step", F.col("step") + F.get(by, F.col("k")))


def session_stream(rows: DataFrame, by: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Closed sessions (append mode). The watermark on event time is this engine's addition."""
    from pyspark.sql import functions as F

    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(*by, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), "n")


def jitter_stream(events: DataFrame, key: str, order: str) -> DataFrame:
    """Playback totals of each stream after each micro-batch; rows have `samples` that arrive and `played` asked for."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = JitterBuffer.from_tuple(state.get) if state.exists else JitterBuffer()
        rows = pd.concat(list(parts)).sort_values(order)
        for samples, played in zip(rows["samples"], rows["played"], strict=True):
            if samples:
                buffer.receive(int(samples))
            if played:
                buffer.play(int(played))
        state.update(buffer.as_tuple())
        yield pd.DataFrame([(k[0], *buffer.totals())], columns=[key, "total", "actual", "missed", "dropped", "min_delay", "max_delay"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {kind}, total bigint, actual bigint, missed bigint, dropped bigint, min_delay bigint, max_delay bigint",
        JitterBuffer.SCHEMA,
        "update",
        GroupStateTimeout.NoTimeout,
    )
