"""The registered queries that SQL cannot express, with their production parameters, against libraries and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tideframe.llm import queries
from tideframe.llm.common import read_table, tokenizer_file

from .test_operators import brute_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] or "" for r in rows}


def encoded(name, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(name))
    return {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}


def test_op3_pieces(spark, texts):
    ids = encoded("byte_bpe_50k.json", texts)
    got = queries.op3_packing(spark, FOLDER).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        ends = np.cumsum([0] + [p["length"] for p in parts]).tolist()
        assert [p["start"] for p in parts] == ends[:-1] and ends[-1] == len(ids[i])
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [p["length"] for p in parts]).tolist()
        assert [p["offset"] for p in parts] == ends[:-1] and ends[-1] <= 2048


def test_op4_components(spark, texts):
    ids = list(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    smallest = brute_components(fps, ids)
    want = {i: (f"{fp:016x}", smallest[k]) for k, (i, fp) in enumerate(zip(ids, fps, strict=True))}
    got = queries.op4_simhash(spark, FOLDER).collect()
    assert len(got) == len(ids)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_op5_records(spark, texts):
    ids = encoded("word_bpe_49k.json", texts)
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    got = queries.op5_binary_output(spark, FOLDER).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_op7_pieces(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = {}
    for i, t in texts.items():
        ids = model.encode(t)
        digests = (",".join(map(str, ids)), model.decode(ids))
        want[i] = (len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in digests])
    got = queries.op7_sentencepiece(spark, FOLDER).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
