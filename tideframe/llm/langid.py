"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte n-grams of its letters (lower case; anything that is not a letter
becomes a blank). Each n-gram is hashed to a row of an embedding table, the rows are averaged, and a
linear softmax gives the probabilities of the languages and of none of them. The model is trained by stochastic
gradient descent in numpy on a bounded sample (`rows_per_lang`, `rows`) and calibrated by a temperature on the part
held back. Answers below a threshold are rejected; it comes from the held-back part's right and wrong answers, and
from the scores that rows get from models that were not shown their language.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; with no
labelled rows every text is `und`; a language with fewer than four sampled rows is learned but not held back;
null ids are never trained on; repeated rows are judged row by row; extra columns are kept or ignored, whatever
their names. Whole texts are read, of any length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, narrow, positional, prepare, texts_of

BUCKET_BITS = 13
DIM = 16
#: Labels that a model tells apart at most; a table with more is refused.
MAX_LANGS = 1024
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLANK_TO = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BLOCK = 1 << 19


@dataclass
class LangModel:
    """weights[b] is the contribution of bucket b to the logits (embedding @ output) of the languages and of no language."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: of the rows held back: share of right answers, mean gap between score and share of right answers,
    #: right answers rejected, and rows of languages kept from a model that it accepts (nan: too few languages)
    accuracy: float = float("nan")
    calibration_error: float = float("nan")
    false_rejections: float = float("nan")
    false_acceptances: float = float("nan")


def letters(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_BLANK_TO) + b" "


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Width and bucket of every n-gram of 2 to 4 bytes, by start."""
    code = data.astype(np.uint32)
    key = code.copy()
    for width in (2, 3, 4):
        if len(code) < width:
            return
        key = key[: len(code) - width + 1] | (code[width - 1 :] << np.uint32(8 * (width - 1)))
        yield width, ((key * np.uint32(2654435769) + np.uint32(width)) * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS)


def counts(text: str) -> np.ndarray:
    """Number of n-grams of a text by bucket."""
    data = np.frombuffer(letters(text), np.uint8)
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for at in range(0, len(data), _BLOCK):
        for width, bucket in grams(data[at : at + _BLOCK + 3]):
            out += np.bincount(bucket[: _BLOCK if len(data) > at + _BLOCK else None], minlength=1 << BUCKET_BITS)
    return out


def descend(x: np.ndarray, label: np.ndarray, n_langs: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by stochastic gradient descent over the languages and one more class, no language.

    A row of that class is a row of the sample, part of whose buckets are put elsewhere: a text whose n-grams no
    language has. Gradients are clipped to length 1; a run that is not finite, or ends worse than it began, starts
    again at half the rate.
    """
    scale = np.float32(20.0)  # frequencies are small; this only sets the size of the hidden layer
    for _ in range(8):
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
        out = rng.normal(0, 0.1, (DIM, n_langs + 1)).astype(np.float32)
        bias = np.zeros(n_langs + 1, np.float32)
        order = np.arange(len(x))
        first = last = 0.0
        with np.errstate(all="ignore"):  # what overflows is found below
            for epoch in range(epochs):
                step = np.float32(rate * (1 - epoch / epochs))
                rng.shuffle(order)
                total = 0.0
                for i in range(0, len(order), 32):
                    rows = order[i : i + 32]
                    some = rows[:: max(2, n_langs)]
                    part = rng.uniform(0.4, 1.0, (len(some), 1)).astype(np.float32)
                    strange = (1 - part) * x[some] + part * x[some][:, rng.permutation(x.shape[1])]
                    xb = np.concatenate([x[rows], strange]) * scale
                    want = np.concatenate([label[rows], np.full(len(some), n_langs)])
                    hidden = xb @ emb
                    p = softmax(hidden @ out + bias)
                    at = (np.arange(len(want)), want)
                    total -= float(np.log(np.maximum(p[at], 1e-12)).sum())
                    p[at] -= 1
                    p /= len(want)
                    steps = (xb.T @ (p @ out.T), hidden.T @ p, p.sum(0))
                    size = np.sqrt(sum(float((g * g).sum()) for g in steps))
                    by = step / np.float32(max(1.0, size))
                    for w, g in zip((emb, out, bias), steps, strict=True):
                        w -= by * (g + np.float32(1e-5) * w)
                first, last = (total if epoch == 0 else first), total
        weights = (emb @ out) * scale
        if np.isfinite(weights).all() and np.isfinite(bias).all() and np.isfinite(last) and last <= first:
            return weights, bias
        rate /= 2
    raise FloatingPointError("the language model does not converge")


def temperature_of(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least loss; right answers count as (n + 1) / (n + 2) sure, so that it stays away from 0."""
    n, k = logits.shape
    want = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    want[np.arange(n), label] = (n + 1) / (n + 2)
    grid = np.geomspace(0.02, 50, 141)
    return float(min(grid, key=lambda t: -(want * np.log(np.maximum(softmax(logits / t), 1e-300))).sum()))


def strangers(label: np.ndarray, x: np.ndarray, held: np.ndarray, n_langs: int, epochs: int, rate: float, seed: int) -> np.ndarray:
    """Scores of held-back rows under models that were not shown their languages, in at most four groups."""
    groups = min(4, n_langs)
    if n_langs < 3:
        return np.zeros(0)
    out = []
    for g in range(groups):
        known = np.arange(n_langs) % groups != g
        name = np.cumsum(known) - 1
        seen = known[label]
        fit, check, other = seen & ~held, seen & held, ~seen & held
        if not fit.any() or not check.any() or not other.any():
            continue
        weights, bias = descend(x[fit], name[label[fit]], int(known.sum()), epochs, rate, seed)
        t = temperature_of(x[check] @ weights + bias, name[label[check]])
        out.append(softmax((x[other] @ weights + bias) / t)[:, :-1].max(1))
    return np.concatenate(out) if out else np.zeros(0)


def threshold_of(right: np.ndarray, wrong: np.ndarray) -> float:
    """The score from which answers are accepted: rejecting a right one costs as much as accepting ten wrong ones.

    Of all scores that cost least, the middle. Without wrong answers: half of the least sure right answer's score.
    """
    if not len(right):
        return 0.5
    if not len(wrong):
        return float(right.min() / 2)
    cuts = np.unique(np.concatenate([right, wrong, [0.0, 1.0]]))
    middle = (cuts[1:] + cuts[:-1]) / 2
    lost = np.searchsorted(np.sort(right), middle) / len(right)
    let_in = 1 - np.searchsorted(np.sort(wrong), middle) / len(wrong)
    cost = 10 * lost + let_in
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((cuts[best[0]] + cuts[best[-1] + 1]) / 2)


def train(langs: list[str], label: np.ndarray, x: np.ndarray, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> LangModel:
    """Fit on rows of bucket frequencies; every fourth row of a language is held back for calibration and rejection."""
    rank = np.zeros(len(x), np.int64)
    for k in range(len(langs)):
        own = label == k
        rank[own] = np.arange(own.sum())
    held = rank % 4 == 3
    weights, bias = descend(x[~held], label[~held], len(langs), epochs, rate, seed)
    check = held if held.any() else ~held
    logits = x[check] @ weights + bias
    temperature = temperature_of(logits, label[check])
    p = softmax(logits / temperature)[:, :-1]
    right, sure = p.argmax(1) == label[check], p.max(1)
    other = strangers(label, x, held, len(langs), epochs, rate, seed)
    threshold = threshold_of(sure[right], np.concatenate([sure[~right], other]))
    edges = np.linspace(0, 1, 11)[1:-1]
    bins = np.digitize(sure, edges)
    gap = sum(abs(float(sure[bins == b].sum() - right[bins == b].sum())) for b in range(10)) / len(sure)
    return LangModel(
        langs, weights.astype(np.float32), bias, temperature, threshold, float(right.mean()), gap,
        float((sure[right] < threshold).mean()) if right.any() else float("nan"),
        float((other >= threshold).mean()) if len(other) else float("nan"),
    )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(model: LangModel | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and acceptance of each text."""
    n = len(texts)
    lang, score, kept = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    known = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    if model is None or not known:
        return lang, score, kept
    parts = [letters(texts[i]) for i in known]
    total = np.zeros((len(known), len(model.bias)))
    many = np.zeros(len(known))
    joined = np.frombuffer(b"".join(parts), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for at in range(0, len(joined), _BLOCK):
        block = joined[at : at + _BLOCK + 3]
        for width, bucket in grams(block):
            bucket = bucket[:_BLOCK]
            end = at + len(bucket)
            first = int(np.searchsorted(start, at, "right")) - 1
            last = int(np.searchsorted(start, end, "left"))
            # n-grams that reach into the next text do not count
            got = model.weights[bucket]
            for b in start[max(first, 0) + 1 : last + 2]:
                got[max(0, b - width + 1 - at) : max(0, b - at)] = 0
            cut = np.maximum(start[first:last], at) - at
            total[first:last] += np.add.reduceat(got, cut, axis=0)
            stop = np.minimum(np.maximum(start[first + 1 : last + 1] - width + 1, at), end) - at
            many[first:last] += np.maximum(stop - cut, 0)
    p = softmax((total / np.maximum(many, 1)[:, None] + model.bias) / model.temperature)[:, : len(model.langs)]
    best = p.argmax(1)
    for k, i in enumerate(known):
        lang[i], score[i] = model.langs[best[k]], p[k, best[k]]
        kept[i] = score[i] >= model.threshold
    return lang, np.clip(score, 0.0, 1.0), kept


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_col.cast("string")) % 4


def fit_langid(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_lang: int = 320,
    rows: int = 8192,
) -> LangModel | None:
    """Train on at most rows_per_lang documents of each language that occurs, and at most `rows` in all.

    Only documents whose fold is not 2 and whose language is known are used. The sample is chosen by a
    hash of id and text, so it does not depend on the partitioning, and exact copies count once. What
    reaches the driver is one vector of 2**BUCKET_BITS counts per sampled document. More than MAX_LANGS labels
    are an error: no language is left out.
    """
    prepare(docs.sparkSession)
    source = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    source = source.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = source.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if not by_lang:
        return None
    if len(by_lang) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} language labels")
    langs = sorted(r["lang"] for r in by_lang)
    rows_per_lang = max(4, min(rows_per_lang, rows // len(langs)))
    space = 1 << 40
    pairs = [F.lit(x) for r in by_lang for x in (r["lang"], min(space, int(space * 1.5 * rows_per_lang / r["count"])))]
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(space))
    picked = source.withColumn("key", key).where(F.col("key") < F.create_map(*pairs)[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for b in batches:
            rows = [zlib.compress(counts(t).astype(np.uint32).tobytes(), 1) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["key", "lang", "x"])

    got = (
        picked.select("key", "lang", "text")
        .mapInArrow(features, "key bigint, lang string, x binary")
        .groupBy("key", "lang")
        .agg(F.first("x").alias("x"))
        .orderBy("key", "lang")
        .limit(rows_per_lang * 2 * len(langs))
        .collect()
    )
    if not got:
        return None
    taken: dict[str, int] = {}
    vectors, label = [], []
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= rows_per_lang:
            x = np.frombuffer(zlib.decompress(r["x"]), np.uint32).astype(np.float32)
            vectors.append(x / max(1.0, x.sum()))
            label.append(langs.index(r["lang"]))
    return train(langs, np.array(label), np.stack(vectors))


def detect_languages(
    docs: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every document; one pass without a shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # 2**BUCKET_BITS rows of a float per label, 33 MB at MAX_LANGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for b in batches:
            lang, score, kept = predict(shared.value, texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(kept)],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_known_language(docs: DataFrame, model: LangModel | None, text_col: str = "text") -> DataFrame:
    """Documents whose language is accepted, with all their columns; all of them if there is no model to judge by."""
    if model is None:
        return docs
    spark = docs.sparkSession
    prepare(spark)
    at, shared = docs.columns.index(text_col), spark.sparkContext.broadcast(model)
    plain = positional(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for b in batches:
            yield b.filter(pa.array(predict(shared.value, texts_of(b.column(at)))[2], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
