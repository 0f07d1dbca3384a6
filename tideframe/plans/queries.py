"""The operators applied to the driver's tables, one query each.

Stand-ins: `events` is a frame stream (session user_id, position by event_id, sample or logit `value`),
`embeddings` are latents and slices of them codebooks, `conversations` are two speakers, `documents` text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import arrays, sampling, text
from ..operators import alignment, framing, layers, metrics, quantize, sequence, state
from ..sources import audio, messages
from ..streaming import jitter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position in the user's stream."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return sequence.numbered(rows, ["user_id"], ["event_id"])


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def book(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    return latents(spark, sf_dir).where(F.col("vec_id").between(low, high - 1)).select(F.col("vec_id").alias("code"), F.col("v").alias("centroid"))


def levels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [book(spark, sf_dir, 32 * k, 32 * k + 32) for k in range(3)]


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


# quantisation


@query
def vq_encode(spark, sf_dir):
    found = quantize.nearest_code(latents(spark, sf_dir), quantize.Codebook(book(spark, sf_dir, 0, 64)), "vec_id", "v")
    return found.select("vec_id", "code", r6("distance").alias("distance"))


@query
def code_histogram(spark, sf_dir):
    found = quantize.nearest_code(latents(spark, sf_dir), quantize.Codebook(book(spark, sf_dir, 0, 64)), "vec_id", "v")
    return found.groupBy("code").agg(F.count("*").alias("n"), r6(F.avg("distance")).alias("mean_distance"))


@query
def rvq_encode(spark, sf_dir):
    books = [quantize.Codebook(b) for b in levels(spark, sf_dir)]
    found = quantize.residual_encode(latents(spark, sf_dir), books, "vec_id", "v")
    error = F.sqrt(arrays.total(F.transform("residual", lambda x: x * x)))
    return found.select("vec_id", *[F.get("codes", F.lit(k)).alias(f"c{k}") for k in range(3)], r6(error).alias("error"))


def _rvq_codes(spark, sf_dir):
    books = [quantize.Codebook(b) for b in levels(spark, sf_dir)]
    return quantize.codes_long(quantize.residual_encode(latents(spark, sf_dir), books, "vec_id", "v"), "vec_id")


def _decoded(spark, sf_dir, used=None):
    books = [quantize.Codebook(b) for b in levels(spark, sf_dir)]
    encoded = quantize.residual_encode(latents(spark, sf_dir), books, "vec_id", "v")
    joined = latents(spark, sf_dir).join(quantize.decode_codes(encoded, books, "vec_id", used), "vec_id")
    return joined.withColumn("error", r6(F.sqrt(arrays.squared_distance(F.col("v"), F.col("decoded")))))


@query
def rvq_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("vec_id", "error", r6(F.get("decoded", F.lit(0))).alias("d0"))


@query
def rvq_decode_two_levels(spark, sf_dir):
    """Only the first two codebooks in use."""
    return _decoded(spark, sf_dir, 2).select("vec_id", "error")


@query
def rvq_lookup(spark, sf_dir):
    """The same decoding by a join of codes with a codebook table, which may be larger than MAX_CODES."""
    dimension = quantize.codebook_table(list(enumerate(levels(spark, sf_dir))))
    decoded = quantize.decode(_rvq_codes(spark, sf_dir), dimension, "vec_id", 64)
    return decoded.select("vec_id", r6(F.get("decoded", F.lit(0))).alias("d0"), r6(F.get("decoded", F.lit(63))).alias("d63"))


@query
def split_decode(spark, sf_dir):
    """Semantic and acoustic parts decoded apart, and their sum."""
    semantic, *acoustic = [quantize.Codebook(b) for b in levels(spark, sf_dir)]
    encoded = quantize.split_encode(latents(spark, sf_dir), semantic, acoustic, "vec_id", "v")
    out = quantize.decode_codes(encoded, [semantic, *acoustic], "vec_id", split=True)
    return out.select("vec_id", *[r6(F.sqrt(arrays.dot(F.col(c), F.col(c)))).alias(c) for c in ("semantic", "acoustic", "decoded")])


@query
def split_rvq(spark, sf_dir):
    semantic, *acoustic = [quantize.Codebook(b) for b in levels(spark, sf_dir)]
    found = quantize.split_encode(latents(spark, sf_dir), semantic, acoustic, "vec_id", "v")
    return found.select("vec_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query
def code_usage_entropy(spark, sf_dir):
    out = quantize.usage_entropy(table(spark, sf_dir, "events"), "event_type", ["user_id"])
    return out.select("user_id", "n_codes", r6("entropy").alias("entropy"))


@query
def centroids(spark, sf_dir):
    out = quantize.centroids(latents(spark, sf_dir), "label", "v", 64)
    norm = F.sqrt(arrays.dot(F.col("centroid"), F.col("centroid")))
    return out.select(F.col("label").cast("bigint").alias("label"), "usage", r6(norm).alias("norm"), r6(F.get("centroid", F.lit(0))).alias("c0"))


@query
def codebook_ema(spark, sf_dir):
    """Usage of label codebooks moved towards the counts of one batch."""
    counts = latents(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return counts.select(F.col("label").cast("bigint").alias("label"), r6(quantize.ema(F.lit(10.0), F.col("n").cast("double"))).alias("usage"))


@query
def expired_codes(spark, sf_dir):
    found = quantize.nearest_code(latents(spark, sf_dir), quantize.Codebook(book(spark, sf_dir, 0, 64)), "vec_id", "v")
    usage = found.groupBy("code").agg(F.count("*").alias("usage"))
    fresh = latents(spark, sf_dir).where(F.col("vec_id").between(100, 163)).select((F.col("vec_id") - 100).alias("code"), F.col("v").alias("vector"))
    out = quantize.replace_expired(book(spark, sf_dir, 0, 64), usage, fresh, 6)
    return out.select("code", r6(F.get("centroid", F.lit(0))).alias("c0"))


@query
def bandwidth(spark, sf_dir):
    used = _rvq_codes(spark, sf_dir).groupBy("level").agg(F.countDistinct("code").alias("n_used"))
    return used.select("level", "n_used", r6(quantize.bandwidth(F.col("level") + 1, C.BINS, C.FRAME_RATE)).alias("kbps"))


@query
def merge_metrics(spark, sf_dir):
    """Averages per event type of even and of odd users, renormalised by level counts 1 and 7."""
    rows = table(spark, sf_dir, "events")
    a = rows.where("user_id % 2 = 0 and event_type <> 'view'").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    b = rows.where("user_id % 2 = 1 and event_type <> 'click'").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return quantize.merge_metrics(a, 1, b, 7).select("metric", r6("value").alias("value"))


@query
def projection(spark, sf_dir):
    """The first four components through a 1x1 projection to two."""
    matrix = [[0.5, 0.25, -1.0, 2.0], [1.0, -0.5, 0.125, 0.0]]
    out = latents(spark, sf_dir).select("vec_id", quantize.project(F.slice("v", 1, 4), matrix).alias("p"))
    return out.select("vec_id", r6(F.get("p", F.lit(0))).alias("p0"), r6(F.get("p", F.lit(1))).alias("p1"))


# framing


@query
def frame_text(spark, sf_dir):
    out = framing.text_frames(table(spark, sf_dir, "documents"), "doc_id", "text", 400)
    return out.select("doc_id", "frame_idx", F.md5("frame").alias("frame_md5"), "n_valid")


@query
def frame_samples(spark, sf_dir):
    """A vector in frames of 24 values, the last filled with zeros, at most three frames."""
    rows = latents(spark, sf_dir).select("vec_id", F.posexplode(framing.frames(F.col("v"), 24, F.lit(0.0), 3)).alias("frame_idx", "f"))
    return rows.select("vec_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.size("f").cast("bigint").alias("n"), r6(arrays.total(F.col("f"))).alias("total"))


@query
def rechunk(spark, sf_dir):
    return framing.rechunk(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text"), 160)


@query
def join_frames(spark, sf_dir):
    """Cut into frames and put together again: the same values."""
    cut = latents(spark, sf_dir).select("vec_id", F.posexplode(framing.frames(F.col("v"), 24)).alias("i", "f"))
    whole = framing.join_frames(cut, ["vec_id"], "i", "f")
    return whole.select("vec_id", F.size("samples").cast("bigint").alias("n"), r6(F.element_at("samples", -1)).alias("last"))


@query
def stereo_zip(spark, sf_dir):
    """Lengths of assistant and user turns of a conversation as two channels of one recording."""
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    side = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.length("text").cast("double").alias("x"))))), lambda s: s["x"])
    both = rows.groupBy("conv_id").agg(side("assistant").alias("a"), side("user").alias("u"))
    out = both.select("conv_id", F.posexplode(framing.stereo(F.col("a"), F.col("u"))).alias("i", "s"))
    return out.select("conv_id", F.col("i").cast("bigint").alias("i"), "s.left", "s.right")


@query
def trim_pad(spark, sf_dir):
    """Vectors brought to the length of 40 + vec_id % 48."""
    n = (F.col("vec_id") % 48 + 40).cast("int")
    out = latents(spark, sf_dir).select("vec_id", arrays.fit_length(F.col("v"), n, F.lit(0.0)).alias("x"))
    return out.select("vec_id", F.size("x").cast("bigint").alias("n"), r6(arrays.total(F.col("x"))).alias("total"))


# alignment


@query
def delay_align(spark, sf_dir):
    out = alignment.delay(stream(spark, sf_dir), ["user_id"], "pos", "value", 2, F.lit(-1.0))
    return out.select("event_id", "delayed")


@query
def undelay_mask(spark, sf_dir):
    out = alignment.undelay(stream(spark, sf_dir), ["user_id"], "pos", "value", 2, F.lit(-1.0))
    return out.select("event_id", "undelayed", F.col("valid").cast("bigint").alias("valid"))


@query
def channel_delays(spark, sf_dir):
    """Events as tokens of 17 channels, put on the delayed grid and gathered back."""
    tokens = stream(spark, sf_dir).select("event_id", F.col("pos").alias("step"), (F.col("event_id") % 17).cast("int").alias("k"))
    grid = alignment.shift_to_grid(tokens, alignment.channels(spark))
    back = alignment.gather(grid.withColumn("slot", F.col("step")), alignment.channels(spark))
    return back.select("event_id", "step", "slot")


@query
def duplex_align(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    sides = {}
    for name, role in (("user_chars", "user"), ("agent_chars", "assistant")):
        own = sequence.numbered(rows.where(F.col("role") == role), ["conv_id"], ["turn"], "idx")
        sides[name] = own.select("conv_id", "idx", F.length("text").cast("bigint").alias("value"))
    return alignment.align_streams(sides, ["conv_id"], "idx")


@query
def stream_add(spark, sf_dir):
    """Two channels' values added as far as both have come."""
    rows = table(spark, sf_dir, "events")
    a, b = (sequence.numbered(rows.where(F.col("event_type") == t), ["user_id"], ["event_id"]).select("user_id", "pos", "value") for t in ("click", "view"))
    return alignment.common_prefix(a, b, ["user_id"], "pos").select("user_id", "pos", r6("value").alias("value"))


@query
def token_overlay(spark, sf_dir):
    rows = stream(spark, sf_dir)
    token = alignment.overlay(F.col("event_id") % 3 == 0, F.col("event_id") % 7, F.col("pos") % 11)
    mask = alignment.loss_mask(F.col("pos") > 0, F.when(F.col("event_id") % 5 == 0, F.lit(C.ZERO_TOKEN)).otherwise(token))
    return rows.select("event_id", token.alias("token"), mask.cast("bigint").alias("in_loss"))


@query
def warm_up(spark, sf_dir):
    """Steps after the largest delay, with the start token in front of each stream."""
    rows = alignment.with_start(stream(spark, sf_dir), ["user_id"], "pos", "value", F.lit(float(C.TEXT_START)))
    return alignment.after_warm_up(rows, "pos", max(C.DELAYS)).select("event_id", "pos", "value")


@query
def initial_tokens(spark, sf_dir):
    out = alignment.initial_tokens(spark).join(alignment.channels(spark), "k")
    return out.select(F.col("k").cast("bigint").alias("k"), F.col("token").cast("bigint").alias("token"), "stream")


@query
def embed_sum(spark, sf_dir):
    """Four channels' embeddings summed per position; -1 counts as nothing, other negatives as row 0."""
    rows = stream(spark, sf_dir).select("user_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    tokens = rows.select("user_id", "pos", F.col("k").cast("bigint").alias("k"), (F.pmod(F.col("pos") * 7 + F.col("k") * 3 + F.col("user_id"), F.lit(19)) - 2).alias("token"))
    lat = latents(spark, sf_dir)
    dimension = lat.where("vec_id < 68").select(F.floor(F.col("vec_id") / 17).alias("k"), (F.col("vec_id") % 17).alias("token"), F.col("v").alias("vector"))
    out = alignment.embed(tokens, dimension, ["user_id", "pos"], 4)
    return out.select("user_id", "pos", *[r6(F.get("embedding", F.lit(i))).alias(f"e{i}") for i in (0, 3)])


# windows


@query
def causal_conv1d(spark, sf_dir):
    out = sequence.causal_conv(stream(spark, sf_dir), ["user_id"], "pos", "value", [0.25, 0.5, -1.0], stride=2)
    return out.select("user_id", "frame", r6("y").alias("y"))


@query
def dilated_conv1d(spark, sf_dir):
    out = sequence.causal_conv(stream(spark, sf_dir), ["user_id"], "pos", "value", [1.0, -0.5, 0.25], dilation=2, bias=1.0)
    return out.select("user_id", "frame", r6("y").alias("y"))


@query
def streaming_conv1d(spark, sf_dir):
    out = sequence.valid_conv(stream(spark, sf_dir), ["user_id"], "pos", "value", [0.5, 0.25, 0.125, 1.0], stride=3)
    return out.select("user_id", "frame", r6("y").alias("y"))


@query
def conv_transpose(spark, sf_dir):
    out = sequence.overlap_add(stream(spark, sf_dir), ["user_id"], "pos", "value", [1.0, 0.5, 0.25], 2, trim=1)
    return out.select("user_id", "t", r6("y").alias("y"))


@query
def downsample(spark, sf_dir):
    out = sequence.downsample(stream(spark, sf_dir), ["user_id"], "pos", "value", 2)
    return out.select("user_id", "frame", r6("y").alias("y"))


@query
def upsample(spark, sf_dir):
    out = sequence.upsample(stream(spark, sf_dir), ["user_id"], "pos", "value", 2)
    return out.select("user_id", "t", r6("y").alias("y"))


@query
def interpolate(spark, sf_dir):
    out = sequence.interpolate(stream(spark, sf_dir), ["user_id"], "pos", "value", 4)
    return out.select("user_id", "t", r6("y").alias("y"))


@query
def ring_context_mean(spark, sf_dir):
    nominal = sequence.ring_context(stream(spark, sf_dir), ["user_id"], "pos", 7, mean=F.avg("value"), n=F.count("*"))
    return nominal.select("event_id", r6("mean").alias("mean"), "n")


@query
def ring_context_strict(spark, sf_dir):
    strict = sequence.ring_context(stream(spark, sf_dir), ["user_id"], "pos", 7, strict=True, mean=F.avg("value"), n=F.count("*"))
    return strict.select("event_id", r6("mean").alias("mean"), "n")


@query
def attention_pool(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("q", F.col("value") / 100)
    out = sequence.attention_pool(rows, ["user_id"], "pos", "q", "q", "value", 8, scale=0.25)
    return out.select("user_id", "pos", r6("pooled").alias("pooled"))


@query
def step_weights(spark, sf_dir):
    weights = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.25)], "step bigint, weight double")
    out = sequence.per_step_weights(stream(spark, sf_dir), weights, "pos", "value")
    return out.select("event_id", r6("y").alias("y"))


@query
def pad_modes(spark, sf_dir):
    v = F.slice("v", 1, 5)
    out = latents(spark, sf_dir).select(
        "vec_id",
        arrays.total(arrays.pad_array(v, 2, 3)).alias("zero"),
        arrays.total(arrays.pad_array(v, 2, 3, "replicate")).alias("edge"),
        arrays.total(arrays.pad_array(v, 2, 3, "reflect")).alias("mirror"),
        arrays.total(arrays.unpad_array(v, 1, 1)).alias("inner"),
        arrays.extra_padding(F.col("vec_id"), 4, 3).alias("extra"),
    )
    return out.select("vec_id", *[r6(c).alias(c) for c in ("zero", "edge", "mirror", "inner")], "extra")


@query
def fades(spark, sf_dir):
    out = latents(spark, sf_dir).select("vec_id", arrays.total(arrays.fade_in(F.col("v"))).alias("a"), arrays.total(arrays.fade_out(F.col("v"))).alias("b"))
    return out.select("vec_id", r6("a").alias("fade_in"), r6("b").alias("fade_out"))


@query
def rope(spark, sf_dir):
    out = latents(spark, sf_dir).select("vec_id", arrays.rope(F.slice("v", 1, 8), F.col("vec_id")).alias("r"))
    return out.select("vec_id", *[r6(F.get("r", F.lit(i))).alias(f"r{i}") for i in (0, 1, 6, 7)])


@query
def sin_embedding(spark, sf_dir):
    out = stream(spark, sf_dir).select("event_id", arrays.sin_embedding(F.col("pos"), 8).alias("e"))
    return out.select("event_id", *[r6(F.get("e", F.lit(i))).alias(f"e{i}") for i in (0, 1, 4, 7)])


# network layers with given weights


def _points(spark, sf_dir) -> DataFrame:
    rows = stream(spark, sf_dir)
    return rows.select("user_id", "pos", F.array(F.col("value") / 497).alias("x"))


@query
def conv_encoder(spark, sf_dir):
    """Two strided convolutions with an activation between them."""
    net = layers.conv_encoder([(np.array([[[0.25, 0.5, -0.25, 0.125]]]), 2), (np.array([[[0.5, 0.25, 0.125, -0.5]]]), 2)])
    out = layers.apply_stack(_points(spark, sf_dir), net, "user_id", "pos", "x", chunk=7)
    return out.select("user_id", "pos", r6(F.get("out", F.lit(0))).alias("y"))


@query
def conv_decoder(spark, sf_dir):
    net = layers.conv_decoder([(np.array([[[1.0, 0.5, 0.25, 0.125]]]), 2)])
    out = layers.apply_stack(_points(spark, sf_dir), net, "user_id", "pos", "x", chunk=7)
    return out.select("user_id", "pos", r6(F.get("out", F.lit(0))).alias("y"))


@query
def rotary_attention(spark, sf_dir):
    """Causal attention with rotary positions over eight steps, added to its input."""
    eye = np.eye(2)
    net = layers.Residual(layers.Attention(np.concatenate([eye, eye, eye]), eye, heads=1, context=8), 0.5)
    rows = stream(spark, sf_dir).select("user_id", "pos", F.array(F.col("value") / 100, (F.col("event_id") % 3).cast("double")).alias("x"))
    out = layers.apply_stack(rows, net, "user_id", "pos", "x", chunk=5)
    return out.select("user_id", "pos", *[r6(F.get("out", F.lit(i))).alias(f"y{i}") for i in (0, 1)])


# normalisation and activations


@query
def rms_norm(spark, sf_dir):
    out = latents(spark, sf_dir).select("vec_id", arrays.rms_norm(F.col("v")).alias("x"))
    return out.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(63))).alias("x63"))


@query
def layer_norm(spark, sf_dir):
    out = latents(spark, sf_dir).select("vec_id", arrays.layer_norm(F.col("v")).alias("x"))
    return out.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(F.get("x", F.lit(63))).alias("x63"))


@query
def activations(spark, sf_dir):
    x = (F.col("value") - 250) / 100
    names = ["identity", "sigmoid", "tanh", "relu", "leaky_relu", "elu", "silu", "mish", "softsign"]
    return table(spark, sf_dir, "events").select("event_id", *[r6(arrays.activation(n, x)).alias(n) for n in names])


@query
def gating(spark, sf_dir):
    scaled = arrays.layer_scale(arrays.gate(F.col("v")), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: i / 32.0))
    return latents(spark, sf_dir).select("vec_id", r6(arrays.total(scaled)).alias("gated"))


# sampling and loss


def logits(spark, sf_dir) -> DataFrame:
    """A step per user; the events are its codes."""
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("code"), (F.col("value") / 100).alias("logit"))


@query
def softmax_temp(spark, sf_dir):
    out = sampling.softmax(logits(spark, sf_dir), ["user_id"], temperature=C.TEXT_TEMPERATURE)
    return out.select("user_id", "code", F.round("p", 9).alias("p"))


@query
def greedy_decode(spark, sf_dir):
    return sampling.greedy(logits(spark, sf_dir), ["user_id"])


@query
def topk_mask(spark, sf_dir):
    out = sampling.top_k(sampling.softmax(logits(spark, sf_dir), ["user_id"]), ["user_id"], 5)
    return out.select("user_id", "code", F.col("rank").cast("bigint").alias("rank"))


@query
def topk_sample(spark, sf_dir):
    return sampling.sample(logits(spark, sf_dir), ["user_id"], F.col("code"), temperature=C.AUDIO_TEMPERATURE, k=5)


@query
def topp_mask(spark, sf_dir):
    out = sampling.top_p(sampling.softmax(logits(spark, sf_dir), ["user_id"]), ["user_id"], 0.5)
    return out.select("user_id", "code", F.round("p", 9).alias("p"))


@query
def topp_sample(spark, sf_dir):
    return sampling.sample(logits(spark, sf_dir), ["user_id"], F.col("code"), p=0.5)


@query
def multinomial_sample(spark, sf_dir):
    return sampling.sample(logits(spark, sf_dir), ["user_id"], F.col("code"))


@query
def sample_vectors(spark, sf_dir):
    rows = latents(spark, sf_dir).select("vec_id")
    return sampling.sample_rows(rows, 20, F.col("vec_id"), rows.count())


@query
def forced_rank_loss(spark, sf_dir):
    probs = sampling.softmax(logits(spark, sf_dir), ["user_id"])
    forced = (F.max("event_id") + F.when(F.col("user_id") % 5 == 0, F.lit(10**9)).otherwise(F.lit(0))).alias("forced")
    targets = table(spark, sf_dir, "events").groupBy("user_id").agg(forced)
    out = metrics.loss_report(probs, targets, ["user_id"])
    return out.select("user_id", "forced", "model_token", "rank", r6("cross_entropy").alias("cross_entropy"))


@query
def ordered_codebook_draws(spark, sf_dir):
    """Codebooks sampled in order within a step, a provided token feeding the next: a fold over the channels."""
    rows = stream(spark, sf_dir).groupBy("user_id", F.floor(F.col("pos") / 4).alias("step")).agg(F.sort_array(F.collect_list(F.struct("pos", "event_id"))).alias("c"))
    fold = F.aggregate("c", F.lit(0).cast("bigint"), lambda before, x: F.when(x["event_id"] % 3 == 0, x["event_id"] % 97).otherwise((before * 31 + x["event_id"]) % 97))
    return rows.select("user_id", "step", fold.alias("last_token"))


# statistics


@query
def latency_ema(spark, sf_dir):
    out = metrics.corrected_ema(stream(spark, sf_dir), ["user_id"], "pos", "value")
    return out.select("event_id", r6("ema").alias("ema"))


@query
def rms_intensity(spark, sf_dir):
    value, level = metrics.intensity(F.col("value"), 0.0, 500.0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r6(value).alias("rms"), level.alias("level"))


@query
def loudness_gain(spark, sf_dir):
    level = metrics.rms_db(F.avg((F.col("value") / 1000) * (F.col("value") / 1000)))
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(level.alias("level"))
    return out.select("user_id", r6("level").alias("level"), r6(metrics.gain_to(F.col("level"))).alias("gain"))


@query
def jitter_playback(spark, sf_dir):
    rows = stream(spark, sf_dir).select(
        "user_id",
        "event_id",
        F.when(F.col("event_type") != "view", (F.col("value") * 8).cast("bigint")).otherwise(F.lit(0)).alias("samples"),
        F.lit(C.FRAME_SIZE).cast("bigint").alias("played"),
    )
    return jitter.playback(rows, "user_id", "event_id")


@query
def inactivity_sessions(spark, sf_dir):
    out = metrics.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


@query
def playback_clock(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("t"))
    return out.select("user_id", text.minutes_seconds(F.round(F.col("t") / 10, 4)).alias("clock"))


# text, prompts and messages


@query
def system_prompt_wrap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'system'")
    again = text.wrap_system(text.wrap_system(F.concat(F.lit(" \n\t"), "text", F.lit("\n"))))
    return rows.select("conv_id", again.alias("prompt"))


@query
def prompt_program(spark, sf_dir):
    """Voice prompt, silence, text prompt, silence of every conversation with a system turn."""
    system = table(spark, sf_dir, "conversations").where("role = 'system'")
    words = system.select("conv_id", F.posexplode(F.split(text.wrap_system(F.col("text")), " ")).alias("phase_step", "token"))
    voice = system.select("conv_id", F.posexplode(F.array(*[F.lit(f"v{c}") for c in C.SINE])).alias("phase_step", "token"))
    quiet = system.select("conv_id", F.posexplode(F.array(*[F.lit("silence")] * 6)).alias("phase_step", "token"))
    return alignment.prompt_program([voice, quiet, words, quiet], ["conv_id"]).select("conv_id", "phase", "step", "token")


def _messages(spark, sf_dir) -> DataFrame:
    kinds = F.get(F.array(*[F.lit(k) for k in C.KINDS]), (F.col("turn") % 7).cast("int"))
    data = F.when(F.col("turn") % 7 == 3, F.get(F.array(*[F.lit(a) for a in C.ACTIONS]), (F.col("conv_id") % 4).cast("int"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", kinds.alias("kind"), data.alias("payload"))
    return rows.withColumn("message", messages.encode(F.col("kind"), F.col("payload")))


@query
def message_codec(spark, sf_dir):
    fine, _ = messages.valid_messages(_messages(spark, sf_dir))
    return fine.select("conv_id", "turn", "type", F.md5(F.coalesce("data", F.lit(""))).alias("data_md5"), F.md5("message").alias("message_md5"))


@query
def message_rejects(spark, sf_dir):
    """Bytes of the texts taken as messages as they are: their first letters are unknown kinds."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, F.unhex(F.lit(""))).otherwise(F.encode("text", "UTF-8")).alias("message"))
    _, bad = messages.valid_messages(rows)
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@query
def message_counters(spark, sf_dir):
    fine, _ = messages.valid_messages(_messages(spark, sf_dir))
    return metrics.message_counts(fine, ["conv_id"])


@query
def json_check(spark, sf_dir):
    """Properties against a schema; rows that lack a field are null."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("k", T.LongType())])
    rows = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 10 == 0, F.lit('{"x": 1}')).otherwise(F.col("props")))
    return rows.select("event_id", messages.checked_json(F.col("raw"), kind)["k"].alias("k"))


@query
def transcript_live(spark, sf_dir):
    """Pieces without padding, in order; and the piece that is spoken now."""
    rows = _pieces(spark, sf_dir).where(~F.col("token").isin(0, 3))
    out = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return out.select("user_id", F.array_join(F.transform("p", lambda x: text.piece_text(x["piece"])), "").alias("text"), text.piece_text(F.element_at("p", -1)["piece"]).alias("current"))


@query
def transcript_offline(spark, sf_dir):
    rows = _pieces(spark, sf_dir).withColumn("shown", text.pad_name(F.col("token"), F.col("piece")))
    return audio.transcript_json(rows, ["user_id"], "pos", "shown")


def _pieces(spark, sf_dir) -> DataFrame:
    rows = stream(spark, sf_dir)
    return rows.select("user_id", "pos", (F.col("event_id") % 5).alias("token"), F.concat(F.lit("▁"), "event_type").alias("piece"))


@query
def session_links(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("turn = 0")
    url = text.link(F.lit("wss://host/api/chat"), text_topk=F.lit(C.TEXT_TOP_K), session=F.col("conv_id"), text_prompt=F.substring("text", 1, 12))
    return rows.select("conv_id", url.alias("url"))


@query
def session_urls(spark, sf_dir):
    """All 11 parameters and the whole first turn; `session_links` is held to its first 12 characters by its SQL."""
    rows = table(spark, sf_dir, "conversations").where("turn = 0")
    seed = F.pmod(F.col("conv_id"), F.lit(1_000_001))
    url = text.session_link(F.lit("wss://host/api/chat"), F.col("text"), F.lit("NATF0.pt"), seed, F.pmod(F.col("conv_id") * 7, F.lit(1_000_001)))
    return rows.select("conv_id", url.alias("url"))


@query
def label_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("NATF")).otherwise(F.lit("VARM")), (F.col("c_custkey") % 4).cast("string"), F.lit(".pt"))
    mail = F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.when(F.col("c_custkey") % 3 == 0, F.lit("@mail")).otherwise(F.lit("@mail.org")))
    return rows.select("c_custkey", text.voice_label(name).alias("label"), text.is_email(mail).cast("bigint").alias("is_email"))


# state


@query
def weight_patch(spark, sf_dir):
    """Nations 8 to 15 are missing from the stored weights and copied from 0 to 7; others above stay missing."""
    nation = table(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_nationkey").cast("bigint").alias("key"))
    have = nation.where("n_nationkey < 8 or n_nationkey = 20").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("value"))
    fallback = F.when(F.col("key").between(8, 15), F.col("key") - 8)
    return state.patch(wanted, have, "key", fallback)


@query
def state_key_audit(spark, sf_dir):
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"))
    given = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + F.when(F.col("s_suppkey") % 9 == 0, 20).otherwise(0)).cast("bigint").alias("key")).distinct()
    return state.key_audit(expected, given, "key")


@query
def state_merge(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("value"))
    extra = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).cast("bigint").alias("key"), F.col("r_name").alias("value"))
    return state.merge(base, extra, "key")


@query
def prompt_lookup(spark, sf_dir):
    """Orders whose customer exists and whose does not, after shifting some keys."""
    catalog = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 10**6).otherwise(0)).alias("key"))
    there, absent = state.existing(asked, catalog, "key")
    return there.agg(F.lit("found").alias("kind"), F.count("*").alias("n")).unionAll(absent.agg(F.lit("absent").alias("kind"), F.count("*").alias("n")))


@query
def flatten_state(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").cast("bigint").alias("key")).alias("region")).alias("nation"),
    )
    return state.flatten_struct(rows, "_")
