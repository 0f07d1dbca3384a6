import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tideframe import constants as C
from tideframe.functions import arrays, sampling, text
from tideframe.operators import alignment, framing, quantize, state
from tideframe.sources import audio, messages


def one(spark, c, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(c.alias("x")).first()["x"]


def test_strip_takes_all_white_space_and_wrapping_is_idempotent(spark):
    df = spark.createDataFrame([(" \t\n hi \r\n",), ("<system> hi <system>",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.wrap_system(F.col("t"))).collect()]
    assert got == ["<system> hi <system>", "<system> hi <system>", "<system>  <system>", None]


def test_minutes_seconds(spark):
    assert [one(spark, text.minutes_seconds(F.lit(x))) for x in (0.0, 61.25, 3599.999)] == ["0:00.00", "1:01.25", "59:59.99"]


def test_samples_and_milliseconds(spark):
    assert one(spark, text.as_samples(F.lit(80))) == C.FRAME_SIZE
    assert one(spark, text.as_ms(F.lit(C.FRAME_SIZE))) == 80.0


@pytest.mark.parametrize("name", ["gelu", "silu", "mish", "elu", "softsign", "leaky_relu"])
def test_activations_at_zero_and_sign(spark, name):
    assert abs(one(spark, arrays.activation(name, F.lit(0.0)))) < 1e-9
    assert one(spark, arrays.activation(name, F.lit(3.0))) > 0.7


def test_unknown_activation(spark):
    with pytest.raises(ValueError):
        arrays.activation("step", F.lit(0.0))


def test_reflect_padding_of_a_short_array(spark):
    a = F.array(*[F.lit(float(x)) for x in (1, 2)])
    assert one(spark, arrays.pad_array(a, 3, 0, "reflect")) == [0.0, 0.0, 2.0, 1.0, 2.0]


@pytest.mark.parametrize("n,frames", [(0, 0), (1, 1), (24, 1), (25, 2), (48, 2)])
def test_frames(spark, n, frames):
    a = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("double")) if n else F.array().cast("array<double>")
    got = one(spark, framing.frames(a, 24, F.lit(0.0)))
    assert len(got) == frames and all(len(x) == 24 for x in got)


def test_draw_frequencies(spark):
    """The exponential race chooses each code with its probability."""
    p = np.array([5, 2, 12, 6, 8, 1, 0, 4], float)
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("step"), F.posexplode(F.array(*[F.lit(float(x)) for x in p / p.sum()])).alias("code", "p"))
    got = sampling.draw(rows, ["step"], F.concat_ws("-", F.col("step"), F.col("code"))).groupBy("token").count().collect()
    seen = Counter({r["token"]: r["count"] for r in got})
    assert max(abs(seen[k] / n - x) for k, x in enumerate(p / p.sum())) < 0.03


def test_sampling_dispatch(spark):
    rows = spark.createDataFrame([(0, c, float(x)) for c, x in enumerate([0, 5, 5, 1])], "step int, code int, logit double")
    for more in ({"use_sampling": False}, {"temperature": 0.0}, {"k": 1}, {"p": 1e-9}):
        assert sampling.sample(rows, ["step"], F.col("code"), **more).first()["token"] == 1
    assert sampling.top_k(sampling.softmax(rows, ["step"]), ["step"], 99).count() == 4


def test_nearest_code_takes_the_lowest_of_equal_ones(spark):
    book = spark.createDataFrame([(3, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [5.0, 5.0])], "code int, centroid array<double>")
    rows = spark.createDataFrame([(1, [0.0, 0.9]), (2, None), (3, [5.0, 4.0])], "id int, v array<double>")
    got = {r["id"]: (r["code"], r["distance"]) for r in quantize.nearest_code(rows, quantize.Codebook(book), "id", "v").collect()}
    assert got[1][0] == 1 and abs(got[1][1] - 0.1) < 1e-12 and got[3] == (2, 1.0) and set(got) == {1, 3}


def test_delay_then_undelay(spark):
    rows = spark.createDataFrame([("a", t, t * 10) for t in range(5)], "s string, t int, x int")
    late = alignment.delay(rows, ["s"], "t", "x", 2, F.lit(-1)).select("s", "t", F.col("delayed").alias("x"))
    back = alignment.undelay(late, ["s"], "t", "x", 2, F.lit(-5)).orderBy("t").collect()
    assert [r["undelayed"] for r in back] == [0, 10, 20, -5, -5]
    assert [r["valid"] for r in back] == [True, True, True, False, False]


def test_token_check_raises(spark):
    with pytest.raises(Exception, match="vocabulary"):
        alignment.check_tokens(spark.createDataFrame([(C.UNGENERATED,)], "token int"), 10).collect()


def test_messages_round_trip(spark):
    rows = [("handshake", None, "000000"), ("audio", "\x00" * 3, "01000000"), ("text", "Hello", "0248656C6C6F"), ("control", "start", "0300"), ("control", "endTurn", "0301"), ("metadata", '{"key":"value"}', None), ("ping", None, "06")]
    df = spark.createDataFrame([r[:2] for r in rows], "kind string, data string").withColumn("m", messages.encode(F.col("kind"), F.col("data")))
    got = df.select("kind", F.hex("m").alias("h"), messages.decode(F.col("m")).alias("d")).collect()
    for r, g in zip(rows, got, strict=True):
        assert g["d"]["type"] == r[0] and g["d"]["error"] is None
        assert r[2] is None or g["h"] == r[2]
    bad = spark.createDataFrame([(b"",), (b"\x09x",), (b"\x03\x07",)], "m binary").select(messages.decode(F.col("m"))["error"]).collect()
    assert [b[0] for b in bad] == ["empty message", "unknown kind", "unknown action"]


def test_queue_answers(spark):
    good = '{"session_id": 1, "status": "wait", "worker_auth_id": null, "worker_addr": null, "current_position": "3"}'
    assert one(spark, messages.check_user(F.lit(good)))["current_position"] == "3"
    assert one(spark, messages.check_user(F.lit(good.replace("wait", "gone")))) is None
    assert one(spark, messages.add_user(F.lit('{"session_id": 1}'))) is None


def test_restore_is_strict(spark):
    want = spark.createDataFrame([("a",), ("b",)], "key string")
    have = spark.createDataFrame([("a", 1), ("c", 2)], "key string, value int")
    with pytest.raises(KeyError, match="missing|left over"):
        state.restore(want, have, "key")
    assert state.restore(want, spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"), "key").count() == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1, 1, width=32), max_size=300))
def test_wav_round_trip(values):
    rate, x = audio.decode_wav(audio.encode_wav(np.array(values, np.float32)))
    assert rate == C.SAMPLE_RATE and x.shape == (1, len(values))
    assert np.abs(x[0] - np.array(values)).max(initial=0) < 2e-4


def test_read_wav_table(spark, tmp_path):
    tone = 0.5 * np.sin(2 * math.pi * 440 * np.arange(2400) / 24_000)
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(tone, 12_000))
    got = audio.read_wav(spark, str(tmp_path)).collect()
    assert len(got) == 1 and len(got[0]["pcm"]) == 4800
