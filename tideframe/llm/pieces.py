"""SentencePiece encoding and decoding through a table of distinct marked words.

Pieces do not cross white space marks, so a text's ids are its marked words' ids in order. Each Python
worker segments a distinct marked word once (see tokens.PieceEncoder) and joins by position.

Defined cases: null text counts as empty, has no ids and decodes to nothing; repeated rows and null ids are
answered row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, prepare, texts_of
from .tokens import piece_encoder


def encode_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = "piece_bpe_32k.model",
    with_text: bool = True,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_text also ids (array) and decoded."""
    prepare(docs.sparkSession)
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for b in batches:
            got = encoder.encode(texts_of(b.column(1)))
            arrays = [
                b.column(0),
                pa.array([g[0] for g in got], pa.int64()),
                pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()),
                pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got], pa.string()),
            ]
            if with_text:
                arrays.append(pa.array([[int(i) for i in g[1].split(",")] if g[1] else [] for g in got], pa.list_(pa.int32())))
                arrays.append(pa.array([g[2] for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema + ", ids array<int>, decoded string" * with_text)
