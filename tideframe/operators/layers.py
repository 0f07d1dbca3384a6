"""Network layers over streams of vectors, with weights as input tables.

A layer maps (time, channels) matrices and can be fed in chunks: `state` is what it carries from one
chunk to the next (the tail of a convolution, the overlap of a transposed one, a ring of keys and values).
Feeding a stream in any chunks gives what feeding it whole gives. `apply_stack` runs a stack over every
stream of a table, one stream at a time; the streams are independent and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Matrix = np.ndarray


def activate(name: str, x: Matrix) -> Matrix:
    kinds: dict[str, Callable[[Matrix], Matrix]] = {
        "identity": lambda v: v,
        "relu": lambda v: np.maximum(v, 0),
        "elu": lambda v: np.where(v > 0, v, np.expm1(np.minimum(v, 0))),
        "silu": lambda v: v / (1 + np.exp(-v)),
        "tanh": np.tanh,
        "sigmoid": lambda v: 1 / (1 + np.exp(-v)),
    }
    return kinds[name](x)


class Layer:
    """forward(x, state) -> (y, state). A state of None starts a stream; last=True ends it."""

    def forward(self, x: Matrix, state: object = None, last: bool = False) -> tuple[Matrix, object]:
        raise NotImplementedError


@dataclass
class Conv(Layer):
    """Causal convolution, weight (out, in, kernel). The left pad is kernel - stride (dilated) zeros, once per stream."""

    weight: Matrix
    bias: Matrix | None = None
    stride: int = 1
    dilation: int = 1

    @property
    def reach(self) -> int:
        return (self.weight.shape[2] - 1) * self.dilation + 1

    def forward(self, x, state=None, last=False):
        width = self.weight.shape[1]
        if state is None:
            state = np.zeros((max(0, self.reach - self.stride), width))
        x = np.concatenate([state, x])
        if last and len(x) > self.reach - self.stride:  # a right pad fills the last window
            short = (-(len(x) - self.reach)) % self.stride
            x = np.concatenate([x, np.zeros((short, width))])
        n = max(0, (len(x) - self.reach) // self.stride + 1)
        taps = np.arange(self.weight.shape[2]) * self.dilation
        at = np.arange(n)[:, None] * self.stride + taps[None, :]
        y = np.einsum("nkc,ock->no", x[at], self.weight) if n else np.zeros((0, self.weight.shape[0]))
        if self.bias is not None:
            y = y + self.bias
        return y, x[n * self.stride :]


@dataclass
class TransposedConv(Layer):
    """Overlap-add, weight (in, out, kernel). The last kernel - stride outputs wait for the next input, and are trimmed at the end."""

    weight: Matrix
    bias: Matrix | None = None
    stride: int = 1

    def forward(self, x, state=None, last=False):
        _, out, kernel = self.weight.shape
        hold = kernel - self.stride
        y = np.zeros((len(x) * self.stride + hold, out))
        if state is not None and hold:
            y[:hold] += state
        for k in range(kernel):
            if len(x):
                y[k : k + (len(x) - 1) * self.stride + 1 : self.stride] += x @ self.weight[:, :, k]
        ready, state = y[: len(x) * self.stride], y[len(x) * self.stride :]
        return (ready + self.bias if self.bias is not None else ready), state


@dataclass
class Activation(Layer):
    name: str = "elu"

    def forward(self, x, state=None, last=False):
        return activate(self.name, x), None


@dataclass
class Linear(Layer):
    weight: Matrix  # (out, in)
    bias: Matrix | None = None

    def forward(self, x, state=None, last=False):
        y = x @ self.weight.T
        return (y + self.bias if self.bias is not None else y), None


@dataclass
class RmsNorm(Layer):
    alpha: Matrix
    eps: float = 1e-8

    def forward(self, x, state=None, last=False):
        return x / np.sqrt((x * x).mean(1, keepdims=True) + self.eps) * self.alpha, None


@dataclass
class GatedFeedForward(Layer):
    """act(a) * b between two linear maps; the first gives a and b side by side."""

    inner: Matrix  # (2 * hidden, in)
    outer: Matrix  # (in, hidden)
    name: str = "silu"

    def forward(self, x, state=None, last=False):
        a, b = np.split(x @ self.inner.T, 2, axis=1)
        return (activate(self.name, a) * b) @ self.outer.T, None


def rotate(x: Matrix, position: np.ndarray, max_period: float = 10_000.0) -> Matrix:
    """Rotary embedding of (time, heads, dim) by neighbouring pairs."""
    d = x.shape[-1]
    angle = position[:, None] * max_period ** (-2 * np.arange(d // 2) / d)
    c, s = np.cos(angle)[:, None, :], np.sin(angle)[:, None, :]
    a, b = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2], out[..., 1::2] = a * c - b * s, a * s + b * c
    return out


@dataclass
class Attention(Layer):
    """Causal self-attention with rotary positions over the last `context` steps (strict: one less)."""

    inner: Matrix  # (3 * dim, dim): queries, keys, values
    outer: Matrix  # (dim, dim)
    heads: int
    context: int
    strict: bool = False
    max_period: float = 10_000.0

    def forward(self, x, state=None, last=False):
        dim = self.outer.shape[0]
        per = dim // self.heads
        at, keys, values = state if state is not None else (0, np.zeros((0, self.heads, per)), np.zeros((0, self.heads, per)))
        if not len(x):
            return np.zeros((0, dim)), (at, keys, values)
        q, k, v = (m.reshape(-1, self.heads, per) for m in np.split(x @ self.inner.T, 3, axis=1))
        position = np.arange(at, at + len(x))
        q, k = rotate(q, position, self.max_period), rotate(k, position, self.max_period)
        keys, values = np.concatenate([keys, k]), np.concatenate([values, v])
        key_position = np.arange(at + len(x) - len(keys), at + len(x))
        delta = position[:, None] - key_position[None, :]
        seen = (delta >= 0) & (delta < self.context - self.strict)
        score = np.einsum("qhd,khd->hqk", q, keys) / np.sqrt(per)
        score = np.where(seen[None], score, -np.inf)
        weight = np.exp(score - score.max(2, keepdims=True))
        weight /= weight.sum(2, keepdims=True)
        y = np.einsum("hqk,khd->qhd", weight, values).reshape(-1, dim) @ self.outer.T
        keep = max(0, len(keys) - (self.context - 1))
        return y, (at + len(x), keys[keep:], values[keep:])


@dataclass
class Stack(Layer):
    """Layers one after another."""

    layers: list[Layer]

    def forward(self, x, state=None, last=False):
        states = list(state) if state is not None else [None] * len(self.layers)
        for n, layer in enumerate(self.layers):
            x, states[n] = layer.forward(x, states[n], last)
        return x, states


@dataclass
class Residual(Layer):
    """x + scale * inner(x). Both sides are added as far as both have come, whichever is ahead."""

    inner: Layer
    scale: Matrix | float = 1.0

    def forward(self, x, state=None, last=False):
        own, waiting, done = state if state is not None else (None, None, None)
        y, own = self.inner.forward(x, own, last)
        waiting = x if waiting is None else np.concatenate([waiting, x])
        done = y if done is None else np.concatenate([done, y])
        n = min(len(waiting), len(done))
        return waiting[:n] + self.scale * done[:n], (own, waiting[n:], done[n:])


def resnet_block(first: Matrix, second: Matrix, dilation: int = 1, name: str = "elu") -> Residual:
    return Residual(Stack([Activation(name), Conv(first, dilation=dilation), Activation(name), Conv(second)]))


def transformer_layer(norm1: Matrix, attention: Attention, norm2: Matrix, feed: GatedFeedForward, scale: float | Matrix = 1.0) -> Stack:
    return Stack([Residual(Stack([RmsNorm(norm1), attention]), scale), Residual(Stack([RmsNorm(norm2), feed]), scale)])


def conv_encoder(weights: list[tuple[Matrix, int]], name: str = "elu") -> Stack:
    """Strided convolutions with activations between them; the hop is the product of the strides."""
    out: list[Layer] = []
    for n, (w, stride) in enumerate(weights):
        out += [Conv(w, stride=stride), *([Activation(name)] if n < len(weights) - 1 else [])]
    return Stack(out)


def conv_decoder(weights: list[tuple[Matrix, int]], name: str = "elu") -> Stack:
    out: list[Layer] = []
    for n, (w, stride) in enumerate(weights):
        out += [TransposedConv(w, stride=stride), *([Activation(name)] if n < len(weights) - 1 else [])]
    return Stack(out)


@dataclass
class Chunked:
    """A layer with its state, fed chunk by chunk."""

    layer: Layer
    state: object = field(default=None)
    width: int = 0

    def feed(self, x: Matrix, last: bool = False) -> Matrix:
        if not x.size:
            if not self.width:
                return np.zeros((0, 0))
            x = np.zeros((0, self.width))
        self.width = x.shape[1]
        y, self.state = self.layer.forward(x, self.state, last)
        return y

    def reset(self) -> None:
        self.state, self.width = None, 0


def apply_stack(rows: DataFrame, layer: Layer, by: str, pos: str, vector: str, chunk: int = 4096) -> DataFrame:
    """(by, pos, out) of the layer over every stream's vectors in order of position.

    Rows are dealt out by stream and sorted, and a task feeds them in chunks: its memory is a chunk and a
    layer's state, not a stream.
    """
    kind = rows.schema[by].dataType.simpleString()
    sorted_rows = rows.select(by, pos, vector).repartition(by).sortWithinPartitions(by, pos)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, feeder, done = None, None, 0

        def give(key, y: Matrix, first: int) -> pd.DataFrame:
            return pd.DataFrame({by: [key] * len(y), pos: range(first, first + len(y)), "out": list(y)})

        for batch in batches:
            fresh = batch[by].ne(batch[by].shift())
            for _, part in batch.groupby(fresh.cumsum(), sort=False):
                key = part[by].iloc[0]
                if feeder is None or key != current:
                    if feeder is not None and len(y := feeder.feed(np.zeros((0, 0)), True)):
                        yield give(current, y, done)
                    current, feeder, done = key, Chunked(layer), 0
                for at in range(0, len(part), chunk):
                    y = feeder.feed(np.array(part[vector].iloc[at : at + chunk].tolist(), float))
                    if len(y):
                        yield give(key, y, done)
                        done += len(y)
        if feeder is not None and len(y := feeder.feed(np.zeros((0, 0)), True)):
            yield give(current, y, done)

    return sorted_rows.mapInPandas(run, f"{by} {kind}, {pos} bigint, out array<double>")
