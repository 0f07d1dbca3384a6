import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tideframe.llm import langid, quality, simhash, suffix
from tideframe.llm.common import read_table
from tideframe.llm.tokens import word_encoder

from .test_operators import brute_removed
from .test_pipeline_whole import brute_near_copies, brute_passages


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in rows.items() if not quality.measure_batch([t.encode()])["failed_bits"][0] & quality.POLICIES["v3"]}
    model = langid.fit_langid(quality.keep_good(docs, "v3"))
    ok = langid.predict(model, list(left.values()))[2]
    left = {i: t for (i, t), k in zip(left.items(), ok, strict=True) if k}
    assert len(left) > 0.7 * len(rows)
    left = {i: left[i] for i in sorted(set(brute_near_copies(list(left.values()), list(left))))}
    texts = [t.encode() for t in left.values()]
    gone = [a | b for a, b in zip(brute_removed(texts, 400), brute_passages(texts, 51), strict=True)]
    cut = [suffix.cut_out(t, g) if len(t) else "" for t, g in zip(texts, gone, strict=True)]
    encoder = word_encoder("byte_bpe_50k.json")
    want = {i: np.append(np.frombuffer(x, encoder.dtype).astype("<u4"), np.array([1], "<u4")) for i, x in zip(left, encoder.encode(cut), strict=True)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))


def test_stages_keep_the_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(60).withColumn("x1", F.lit(1)).withColumn("x2", F.lit("b"))
    docs = docs.toDF(*docs.columns[:-2], "x", "x")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.ORACLE_SQL is None and simhash.RADIUS == 4
