"""Repeated rows at volume, hot cores, and strings of words."""

import random
import time

import numpy as np
import pytest
from tideframe.llm import suffix

from .test_operators import brute_removed, docs
from .test_pipeline_whole import brute_passages


def test_word_codes():
    rng = random.Random(2)
    text = "".join(rng.choice("ab é\t\n\x0b  z漢\x1c") for _ in range(5000)).encode()
    start, end = suffix.word_places(text)
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == text.split()
    codes = np.frombuffer(suffix.word_codes(text), "<u4")
    seen = {}
    assert all(seen.setdefault(w, c) == c for w, c in zip(text.split(), codes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)
    assert suffix.word_codes(b"") == b"" and len(suffix.word_codes(b" x ")) == suffix.CODE


def test_codes_of_very_long_texts():
    word = b"w" * ((1 << 20) + (1 << 16) + 9)
    text = b"aa bb " * 300_000 + word + b" aa " + word + b" bb"
    codes = np.frombuffer(suffix.word_codes(text), "<u4")
    assert len(codes) == 600_004
    assert len(set(codes[:600_000].tolist())) == 2 and codes[-4] == codes[-2] and codes[-3] == codes[0] and codes[-1] == codes[1]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_a_common_passage_in_many_surroundings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(hot)
    word = lambda n: " ".join(rng.choice(["ab", "to", "of", "x", "yz"]) + str(rng.randrange(30)) for _ in range(n))
    passage, tails = word(20), [word(6) for _ in range(3)]
    rows = [(k, f"{word(rng.randrange(1, 12))} {passage} {rng.choice(tails)} {word(rng.randrange(1, 12))}") for k in range(60)]
    rows += [(70, passage), (71, passage * 3), (72, "z" * 200), (72, "z" * 200)]
    texts = [t.encode() for _, t in rows]
    found = suffix.repeated_spans(docs(spark, rows), window=50, words=12).collect()
    bytes_, said = brute_removed(texts, 50), brute_passages(texts, 12)
    want = sorted((i, int(g.sum()), int(p.sum())) for (i, _), g, p in zip(rows, bytes_, said, strict=True))
    assert sorted((r["doc_id"], r["n_removed"], r["n_passage_bytes"]) for r in found) == want


def test_ten_thousand_equal_rows(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(120))
    rows = docs(spark, [(1, text)]).selectExpr("*", "explode(sequence(1, 10000)) as more")
    began = time.time()
    got = suffix.repeated_spans(rows, words=51).groupBy("n_bytes", "n_removed", "n_passage_bytes").count().collect()
    assert [tuple(r) for r in got] == [(len(text), len(text), len(text), 10000)]
    assert time.time() - began < 60
