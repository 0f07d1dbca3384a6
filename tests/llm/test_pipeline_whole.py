"""The pipeline's stages against their own contract: near copies of 0.8 by five-word shingles, passages of over 50 words."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from tideframe.llm import simhash, suffix
from tideframe.llm.common import read_table

from .test_operators import brute_removed, docs


def brute_near_copies(texts, ids):
    """For each text the smallest id that pairs of Jaccard similarity 0.8 or more connect it with."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    comp = list(ids)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        before = list(comp)
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return comp


def test_near_copies_beyond_the_radius_go(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    comp = brute_near_copies(list(rows.values()), list(rows))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, docs, sf_dir).collect())
    assert kept == sorted(set(comp)) and len(kept) < simhash.near_duplicates(docs).select("component_id").distinct().count()


def brute_passages(texts, words):
    place = [[m.span() for m in re.finditer(rb"\S+", t)] for t in texts]
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for t, p, w in zip(texts, place, split, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[p[i][0] : p[i + words - 1][1]] = True
        out.append(gone)
    return out


def test_passages_of_51_short_words_go(spark, sf_dir):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["ab", "to", "zéro", "of", "x", "漢字"]) + str(rng.randrange(99)) for _ in range(n))
    shared, short = text(51), text(50)
    assert len(shared.encode()) < 400
    rows = [(0, None), (1, ""), (2, text(80))]
    rows += [(10 + k, f"{text(20 + k)} {shared}\n{text(30)}") for k in range(4)]
    rows += [(20 + k, f"{text(9)} {short} {text(9)}") for k in range(3)] + [(30, f"{shared.replace(' ', '  ')} {text(5)}")]
    rows += [(40, text(120))] * 2 + [(41, "y" * 450), (42, "y" * 450 + " z")]
    texts = [(t or "").encode() for _, t in rows]
    gone = [a | b for a, b in zip(brute_passages(texts, 51), brute_removed(texts, 400), strict=True)]
    want = sorted((i, None if t is None else suffix.cut_out(x, g) if x else "") for (i, t), x, g in zip(rows, texts, gone, strict=True))
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.repeats(spark, docs(spark, rows), sf_dir).collect())
    assert [(i, t or "") for i, t in got] == [(i, t or "") for i, t in want]
    left = dict(got)
    assert shared not in left[10] and short in left[20]


def test_repeats_of_the_table(spark, sf_dir):
    table = read_table(spark, sf_dir, "documents").limit(120)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    texts = [t.encode() for _, t in rows]
    gone = [a | b for a, b in zip(brute_passages(texts, 51), brute_removed(texts, 400), strict=True)]
    want = {i: suffix.cut_out(x, g) if x else "" for (i, _), x, g in zip(rows, texts, gone, strict=True)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, table, sf_dir).collect()} == want
