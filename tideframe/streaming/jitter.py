"""A jitter buffer as plain state, counted in samples.

It holds what has arrived and not been played. Playing starts once a frame is there and a further short
wait is over. Beyond the cap the oldest samples are dropped down to the target, and the cap grows. If
it runs dry, what there is is played, the wait grows, and buffering starts again.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame

from .. import constants as C


def _ms(n: int) -> int:
    return int(n * C.SAMPLE_RATE / 1000 + 0.5)


@dataclass
class JitterBuffer:
    held: int = 0
    started: int = 0
    wait_left: int = 0
    wait: int = _ms(10)
    slack: int = _ms(10)
    stream_at: int = 0
    total: int = 0
    actual: int = 0
    dropped: int = 0
    min_delay: int = -1
    max_delay: int = 0

    FIRST: ClassVar[int] = _ms(80)
    GROWTH: ClassVar[int] = _ms(5)
    MOST: ClassVar[int] = _ms(80)
    SCHEMA: ClassVar[str] = ", ".join(
        f"{n} bigint" for n in ("held", "started", "wait_left", "wait", "slack", "stream_at", "total", "actual", "dropped", "min_delay", "max_delay")
    )

    @classmethod
    def from_tuple(cls, values: tuple) -> JitterBuffer:
        return cls(*[int(v) for v in values])

    def as_tuple(self) -> tuple:
        return astuple(self)

    def receive(self, samples: int) -> int:
        """Take a packet; returns how many of the oldest samples are dropped."""
        self.held += samples
        if self.held >= self.FIRST and not self.started:
            self.started, self.wait_left = 1, self.wait
        target = self.FIRST + self.wait
        lost = 0
        if self.held >= target + self.slack:
            lost = max(0, self.held - target)
            self.held -= lost
            self.stream_at += lost
            self.dropped += lost
            self.slack = min(self.MOST, self.slack + self.GROWTH)
        return lost

    def play(self, samples: int) -> int:
        """Ask for samples; returns how many are played."""
        if not (self.started and self.held and self.wait_left <= 0):
            if self.actual:
                self.total += samples
            self.wait_left -= samples
            return 0
        self.max_delay = max(self.max_delay, self.held)
        self.min_delay = self.held if self.min_delay < 0 else min(self.min_delay, self.held)
        given = min(samples, self.held)
        self.held -= given
        if given < samples:
            self.wait = min(self.wait + self.GROWTH, self.MOST)
            self.started = 0
        self.total += samples
        self.actual += given
        self.stream_at += given
        return given

    def totals(self) -> tuple[int, int, int, int, int, int]:
        return self.total, self.actual, self.total - self.actual, self.dropped, self.min_delay, self.max_delay


def playback(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, total, actual, missed, dropped, min_delay, max_delay) of each stream's ordered rows (samples, played)."""
    names = ["total", "actual", "missed", "dropped", "min_delay", "max_delay"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        buffer = JitterBuffer()
        for samples, played in zip(rows["samples"], rows["played"], strict=True):
            if samples:
                buffer.receive(int(samples))
            if played:
                buffer.play(int(played))
        return pd.DataFrame([(rows[key].iloc[0], *buffer.totals())], columns=[key, *names])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, order, "samples", "played").groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} bigint" for n in names))
