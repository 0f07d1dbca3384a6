"""Expressions over arrays of numbers. All are built-in Spark functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def scale(a: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return F.transform(a, lambda x: x * by)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def rms(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside lambdas over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rms_norm(a: Column, eps: float = 1e-8, alpha: float = 1.0) -> Column:
    by = alpha / F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a) + eps)
    return let(by, lambda k: F.transform(a, lambda x: x * k))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    def scaled(centred: Column) -> Column:
        by = 1.0 / F.sqrt(total(F.transform(centred, lambda x: x * x)) / F.size(centred) + eps)
        return let(by, lambda k: F.transform(centred, lambda x: x * k))

    return let(let(mean(a), lambda m: F.transform(a, lambda x: x - m)), scaled)


def layer_scale(a: Column, by: Column) -> Column:
    return F.zip_with(a, by, lambda x, y: x * y)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.least(F.greatest(x, low), high)


def activation(name: str, x: Column) -> Column:
    """The named activations a gate can use."""
    sig = 1.0 / (1.0 + F.exp(-x))
    kinds = {
        "identity": lambda: x,
        "sigmoid": lambda: sig,
        "tanh": lambda: F.tanh(x),
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "leaky_relu": lambda: F.when(x > 0, x).otherwise(0.01 * x),
        "elu": lambda: F.when(x > 0, x).otherwise(F.exp(x) - 1.0),
        "gelu": lambda: x * (0.5 * (1.0 + erf(x / math.sqrt(2.0)))),
        "silu": lambda: x * sig,
        "mish": lambda: x * F.tanh(F.log1p(F.exp(x))),
        "softsign": lambda: x / (1.0 + F.abs(x)),
    }
    if name not in kinds:
        raise ValueError(f"unknown activation {name}")
    return kinds[name]()


def erf(x: Column) -> Column:
    """Error function by a rational approximation (absolute error below 1.5e-7)."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gate(a: Column, name: str = "silu") -> Column:
    """First half of an array through an activation, times the second half."""
    half = (F.size(a) / 2).cast("int")
    return F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: activation(name, x) * y)


def rope(a: Column, position: Column, max_period: float = 10000.0) -> Column:
    """Rotary embedding: neighbours (2i, 2i+1) are turned by position * max_period^(-2i/d)."""
    d = F.size(a)

    def turned(x: Column, i: Column) -> Column:
        pair = F.floor(i / 2)
        angle = position * F.exp(pair * (-math.log(max_period) * 2.0) / d)
        other = F.element_at(a, (F.when(i % 2 == 0, i + 2).otherwise(i)).cast("int"))
        return F.when(i % 2 == 0, x * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + x * F.cos(angle))

    return F.transform(a, turned)


def sin_embedding(position: Column, dim: int, max_period: float = 10000.0) -> Column:
    """Cosines and then sines of the position at dim/2 frequencies from 1 down to 1/max_period."""
    half = dim // 2
    index = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: position / F.pow(F.lit(max_period), i / float(half - 1)))
    return F.concat(F.transform(index, F.cos), F.transform(index, F.sin))


def sine_wave(n: Column, sample_rate: int = 24_000, hertz: float = 440.0, amplitude: float = 0.5) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: amplitude * F.sin(2 * math.pi * hertz * i / sample_rate))


def fit_length(a: Column, n: Column, fill: Column) -> Column:
    """Trim to n values, or fill up to n."""
    missing = F.greatest(n - F.size(a), F.lit(0)).cast("int")
    return F.concat(F.slice(a, F.lit(1), F.least(n, F.size(a)).cast("int")), F.array_repeat(fill, missing))


def fade_in(a: Column) -> Column:
    return F.transform(a, lambda x, i: x * i / F.size(a))


def fade_out(a: Column) -> Column:
    return F.transform(a, lambda x, i: x * (F.size(a) - i) / F.size(a))


def pad_array(a: Column, left: int, right: int, mode: str = "constant", value: float = 0.0) -> Column:
    """Pad both ends by a value, by the edge values, or by reflection (short arrays are first filled up)."""
    if mode == "constant":
        return F.concat(F.array_repeat(F.lit(value), left), a, F.array_repeat(F.lit(value), right))
    if mode == "replicate":
        return F.concat(F.array_repeat(F.get(a, F.lit(0)), left), a, F.array_repeat(F.element_at(a, -1), right))
    if mode == "reflect":
        need = max(left, right) + 1
        extra = F.greatest(need - F.size(a), F.lit(0))
        full = F.concat(a, F.array_repeat(F.lit(0.0), extra.cast("int")))
        out = F.concat(
            F.reverse(F.slice(full, 2, left)) if left else F.array().cast("array<double>"),
            full,
            F.slice(F.reverse(full), 2, right) if right else F.array().cast("array<double>"),
        )
        return F.slice(out, F.lit(1), (F.size(out) - extra).cast("int"))
    raise ValueError(f"unknown padding {mode}")


def unpad_array(a: Column, left: int, right: int) -> Column:
    return F.slice(a, F.lit(left + 1), F.size(a) - left - right)


def extra_padding(n: Column, kernel: int, stride: int, padding_total: int = 0) -> Column:
    """Values to add at the right so that the last window is full."""
    frames = (n - kernel + padding_total) / float(stride) + 1
    return ((F.ceil(frames) - 1) * stride + kernel - padding_total - n).cast("bigint")
