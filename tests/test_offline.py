import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tideframe import schemas
from tideframe.config import Parameters, required
from tideframe.operators import alignment, quantize, state
from tideframe.plans import offline
from tideframe.sources import audio, loudness


def test_recordings_through_the_codec(spark, tmp_path):
    rng = np.random.default_rng(1)
    size, dim = 40, 4
    basis = np.linalg.qr(rng.normal(size=(size, dim)))[0]
    points = rng.normal(size=(6, dim)) * 0.1
    wave = np.concatenate([points[k] @ basis.T for k in (3, 1, 5)])[:-7]
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(wave))
    (tmp_path / "b.wav").write_bytes(audio.encode_wav(np.zeros(0)))
    book = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "code bigint, centroid array<double>")
    zero = spark.createDataFrame([(0, [0.0] * dim), (1, [9.0] * dim)], "code bigint, centroid array<double>")
    recordings = audio.read_wav(spark, str(tmp_path / "*.wav"))
    codes = offline.encode(recordings, basis.T, [quantize.Codebook(book), quantize.Codebook(zero)], size).orderBy("frame_idx").collect()
    assert [r["codes"] for r in codes][:2] == [[3, 0], [1, 0]]
    out = offline.run(recordings, basis.T, basis, [book, zero], size)
    got = out.where(F.col("path").endswith("a.wav")).first()["pcm"]
    assert len(got) == len(wave) and np.abs(np.array(got) - wave)[: 2 * size].max() < 1e-3
    files = offline.write(out, f"file://{tmp_path}/out").collect()
    assert files[0]["n_samples"] == len(wave) and audio.decode_wav((tmp_path / "out" / files[0]["path"].split("/")[-1]).read_bytes())[1].shape == (1, len(wave))
    assert quantize.commitment(quantize.residual_encode(spark.createDataFrame([(0, points[2].tolist())], "id int, v array<double>"), [quantize.Codebook(book)], "id", "v")).first()[0] < 1e-20


def test_loudness(spark):
    rate = 24_000
    tone = 0.5 * np.sin(2 * math.pi * 997 * np.arange(3 * rate) / rate)
    level = loudness.integrated_loudness(tone, rate)
    assert level == pytest.approx(-0.691 + 10 * math.log10(0.125) + 0.691, abs=0.2)  # the weighting is 0.69 dB at 997 Hz
    df = spark.createDataFrame([("t", tone.tolist()), ("z", [0.0] * rate)], "k string, x array<double>")
    rows = {r["k"]: np.array(r["pcm"]) for r in loudness.normalise(df, "k", "x").collect()}
    assert loudness.integrated_loudness(rows["t"], rate) == pytest.approx(-24, abs=0.01) and not rows["z"].any()


def test_generation(spark):
    dimension = spark.createDataFrame([(0, "text", 0), (1, "agent", 1)], schemas.CHANNEL)
    sampled = spark.createDataFrame([("s", k, t, 10 * k + t) for k in (0, 1) for t in range(4)], "s string, k int, step bigint, token bigint")
    given = spark.createDataFrame([("s", 1, 1, 99), ("s", 0, 0, 77)], "s string, k int, step bigint, token bigint")
    got = {(r["k"], r["step"]): r["token"] for r in alignment.generate(sampled, given, dimension, ["s"]).collect()}
    assert got == {(0, 0): 77, (0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 0): 11, (1, 1): 99, (1, 2): 13}


def test_state_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a.b", [1.0]), ("a.c", [2.0])], "key string, value array<double>")
    state.save(df, str(tmp_path / "s"), {"offset": 3, "name": None, "on": True})
    back, meta = state.load(spark, str(tmp_path / "s"))
    assert meta == {"offset": 3, "name": None, "on": True} and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(TypeError):
        state.save(df, str(tmp_path / "t"), {"x": [1]})


def test_parameters():
    assert Parameters().with_(text_top_k=None, pad_mult=0).text_top_k == 25
    with pytest.raises(ValueError):
        Parameters(text_temperature=0.0)
    assert required({"a": "1"}, "a") == {"a": "1"}
    with pytest.raises(KeyError):
        required({"a": ""}, "a")


def test_schemas_parse(spark):
    for name in dir(schemas):
        if name.isupper():
            assert spark.createDataFrame([], getattr(schemas, name)).columns
