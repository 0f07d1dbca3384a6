"""Layers fed in chunks give what they give fed whole."""

import numpy as np
import pytest
from tideframe.operators import layers as L

RNG = np.random.default_rng(0)


def feed(layer, x, chunk):
    fed = L.Chunked(layer)
    parts = [fed.feed(x[at : at + chunk]) for at in range(0, len(x), chunk)]
    parts.append(fed.feed(np.zeros((0, 0)), True))
    return np.concatenate([p for p in parts if p.size] or [np.zeros((0, 1))])


@pytest.mark.parametrize("kernel", [1, 3, 4, 8, 15, 16])
@pytest.mark.parametrize("stride", [1, 2, 3, 9])
@pytest.mark.parametrize("length", [4, 8, 32, 65])
def test_convolutions(kernel, stride, length):
    if stride > kernel:
        pytest.skip("strides do not exceed kernels")
    x = RNG.normal(size=(length, 3))
    conv, back = L.Conv(RNG.normal(size=(5, 3, kernel)), RNG.normal(size=5), stride), L.TransposedConv(RNG.normal(size=(3, 2, kernel)), RNG.normal(size=2), stride)
    for layer, n in ((conv, -(-length // stride)), (back, length * stride)):
        whole = feed(layer, x, length)
        assert len(whole) == n
        for chunk in (1, 3, 5, 8):
            got = feed(layer, x, chunk)
            assert got.shape == whole.shape and np.abs(got - whole).max() <= 1e-6 * max(1, np.abs(whole).max())


def test_convolution_by_hand():
    y = feed(L.Conv(np.array([[[1.0, 2.0, 3.0]]])), np.array([[1.0], [10.0], [100.0]]), 2)
    assert y.ravel().tolist() == [3.0, 32.0, 321.0]
    y = feed(L.TransposedConv(np.array([[[1.0, 2.0, 3.0]]]), stride=2), np.array([[1.0], [10.0]]), 1)
    assert y.ravel().tolist() == [1.0, 2.0, 13.0, 20.0]


def stacks():
    d = 8
    attention = L.Attention(RNG.normal(size=(3 * d, d)), RNG.normal(size=(d, d)), heads=2, context=5)
    feed_forward = L.GatedFeedForward(RNG.normal(size=(24, d)), RNG.normal(size=(d, 12)))
    yield "transformer", L.transformer_layer(np.ones(d), attention, np.ones(d), feed_forward, 0.1)
    yield "resnet", L.resnet_block(RNG.normal(size=(4, d, 3)), RNG.normal(size=(d, 4, 1)), dilation=2)
    yield "encoder", L.conv_encoder([(RNG.normal(size=(6, d, 4)), 2), (RNG.normal(size=(3, 6, 6)), 3)])
    yield "decoder", L.conv_decoder([(RNG.normal(size=(d, 6, 4)), 2), (RNG.normal(size=(6, 3, 6)), 3)])


@pytest.mark.parametrize("name,stack", list(stacks()))
def test_stacks(name, stack):
    x = RNG.normal(size=(41, 8))
    whole = feed(stack, x, 41)
    for chunk in (1, 4, 7):
        got = feed(stack, x, chunk)
        assert got.shape == whole.shape and np.allclose(got, whole, rtol=1e-6)


def test_strict_ring_sees_one_step_less():
    eye = np.eye(2)
    x = RNG.normal(size=(9, 2))
    nominal = L.Attention(np.concatenate([eye * 0, eye * 0, eye]), eye, 1, 4)
    strict = L.Attention(np.concatenate([eye * 0, eye * 0, eye]), eye, 1, 4, strict=True)
    assert np.allclose(feed(nominal, x, 2)[-1], x[-4:].mean(0)) and np.allclose(feed(strict, x, 2)[-1], x[-3:].mean(0))
