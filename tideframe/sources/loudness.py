"""Integrated loudness by ITU-R BS.1770 (K-weighting and two gates), and normalisation to a target."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import constants as C


def _shelf(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """High shelf: +4 dB from about 1.7 kHz."""
    gain, q, f = 3.999843853973347, 0.7071752369554196, 1681.974450955533
    k, vh = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    return np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


def _high_pass(rate: int) -> tuple[np.ndarray, np.ndarray]:
    q, f = 0.5003270373238773, 38.13547087602444
    k = math.tan(math.pi * f / rate)
    a0 = 1 + k / q + k * k
    return np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


def _impulse(rate: int, n: int = 1 << 14) -> np.ndarray:
    """Impulse response of both filters in a row, long enough to have died away."""
    x = np.zeros(n)
    x[0] = 1.0
    for b, a in (_shelf(rate), _high_pass(rate)):
        y = np.zeros(n)
        for i in range(n):
            y[i] = b[0] * x[i] + (b[1] * x[i - 1] - a[1] * y[i - 1] if i > 0 else 0) + (b[2] * x[i - 2] - a[2] * y[i - 2] if i > 1 else 0)
        x = y
    return x


def integrated_loudness(x: np.ndarray, rate: int = C.SAMPLE_RATE, impulse: np.ndarray | None = None) -> float:
    """LUFS of a mono signal; -inf if nothing passes the gates."""
    block, hop = int(0.4 * rate), int(0.1 * rate)
    if len(x) < block:
        return -math.inf
    h = _impulse(rate) if impulse is None else impulse
    n = 1 << (len(x) + len(h) - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]
    total = np.concatenate([[0.0], np.cumsum(y * y)])
    start = np.arange(0, len(x) - block + 1, hop)
    power = (total[start + block] - total[start]) / block
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-300))
    kept = power[level > -70]
    if not len(kept):
        return -math.inf
    gate = -0.691 + 10 * math.log10(kept.mean()) - 10
    kept = power[(level > -70) & (level > gate)]
    return -0.691 + 10 * math.log10(kept.mean()) if len(kept) else -math.inf


def normalise(table: DataFrame, key: str, pcm: str, target: float = -24.0, rate: int = C.SAMPLE_RATE) -> DataFrame:
    """(key, loudness, pcm) with every signal brought to the target; silence stays as it is."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = _impulse(rate)
        for b in batches:
            rows = []
            for k, values in zip(b[key], b[pcm], strict=True):
                x = np.asarray(values, float)
                level = integrated_loudness(x, rate, h)
                rows.append((k, level, (x * 10 ** ((target - level) / 20) if math.isfinite(level) else x).tolist()))
            yield pd.DataFrame(rows, columns=[key, "loudness", "pcm"])

    return table.select(key, pcm).mapInPandas(run, f"{key} {kind}, loudness double, pcm array<double>")
