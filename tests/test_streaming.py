"""Streaming operators give what their batch forms give, however the input is cut."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tideframe.operators import metrics, sequence
from tideframe.streaming import jitter, processors
from tideframe.streaming.jitter import JitterBuffer


def files(spark, path, rows, schema, cuts):
    """Write rows as one parquet file per cut, in order."""
    pos = [0, *sorted(cuts), len(rows)]
    for n, (a, b) in enumerate(zip(pos[:-1], pos[1:], strict=True)):
        if b > a:
            pdf = pd.DataFrame(rows[a:b], columns=[f.split()[0] for f in schema.split(", ")])
            spark.createDataFrame(pdf, schema).coalesce(1).write.parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("size,cuts", [(3, [1, 2]), (8, [4])])
def test_rechunk(spark, tmp_path, size, cuts):
    rng = random.Random(size)
    rows = [(k % 2, k, "x" * rng.randrange(0, 9) + str(k)) for k in range(8)]
    stream = files(spark, str(tmp_path / "in"), rows, "s bigint, n bigint, t string", cuts)
    got = run(processors.rechunk_stream(stream, "s", "n", "t", size), tmp_path, f"rechunk{size}")
    for s in (0, 1):
        whole = "".join(r[2] for r in rows if r[0] == s)
        want = [whole[i : i + size] for i in range(0, len(whole) - size + 1, size)]
        assert [r["frame"] for r in got.where(F.col("s") == s).orderBy("frame_idx").collect()] == want


def test_ema(spark, tmp_path):
    rows = [(1, k, float(k * k % 17)) for k in range(9)]
    schema = "s bigint, n bigint, x double"
    stream = files(spark, str(tmp_path / "in"), rows, schema, [2, 5])
    got = run(processors.ema_stream(stream, "s", "n", "x"), tmp_path, "ema")
    batch = metrics.corrected_ema(spark.createDataFrame(rows, schema), ["s"], "n", "x")
    a, b = ([r["ema"] for r in t.orderBy("n").collect()] for t in (got, batch))
    assert a == pytest.approx(b, rel=1e-9)


def test_jitter(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 2, k, rng.choice([0, 0, 1920, 960, 5000]), rng.choice([128, 1920])) for k in range(60)]
    schema = "s bigint, n bigint, samples bigint, played bigint"
    stream = files(spark, str(tmp_path / "in"), rows, schema, [20])
    got = run(processors.jitter_stream(stream, "s", "n"), tmp_path, "jitter", "update")
    batch = {r["s"]: tuple(r) for r in jitter.playback(spark.createDataFrame(rows, schema), "s", "n").collect()}
    last = {}
    for r in got.collect():
        if r["s"] not in last or r["total"] >= last[r["s"]][1]:
            last[r["s"]] = tuple(r)
    assert last == batch


def test_jitter_rules():
    b = JitterBuffer()
    assert b.play(128) == 0 and b.total == 0
    b.receive(1920)
    assert b.started and b.play(240) == 0 and b.play(240) == 240  # waits 10 ms more
    assert b.receive(5000) == b.dropped > 0 and b.held == 1920 + 240
    while b.started:
        b.play(480)
    assert b.wait == 240 + 120 and b.held == 0


def test_closed_sessions(spark, tmp_path):
    rows = [(1, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)) for h in (0, 1, 10, 11, 40, 41, 80)]
    stream = files(spark, str(tmp_path / "in"), rows, "u bigint, ts timestamp", [3, 5])
    got = run(processors.session_stream(stream, ["u"], "ts", "6 hours", "1 hour"), tmp_path, "sessions")
    counts = [r["n"] for r in got.orderBy("start").collect()]
    assert counts == [2, 2, 2][: len(counts)] and counts


@pytest.mark.parametrize("kernel,stride", [(1, 1), (3, 1), (3, 2), (4, 4), (8, 3)])
@pytest.mark.parametrize("length", [8, 33])
def test_convolution_of_chunks(spark, kernel, stride, length):
    """Unpadded windows: frames of the whole equal frames of the parts with a carried tail."""
    rng = random.Random(kernel * 10 + stride)
    x = [rng.uniform(-1, 1) for _ in range(length)]
    w = [rng.uniform(-1, 1) for _ in range(kernel)]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "s int, pos int, x double")
    got = [r["y"] for r in sequence.valid_conv(rows, ["s"], "pos", "x", w, stride).orderBy("frame").collect()]
    out, tail = [], []
    for at in range(0, length, 5):
        tail = tail + x[at : at + 5]
        while len(tail) >= kernel:
            out.append(sum(a * b for a, b in zip(w, tail[:kernel], strict=True)))
            tail = tail[stride:]
    assert got == pytest.approx(out, abs=1e-6) and len(got) == max(0, (length - kernel) // stride + 1)
