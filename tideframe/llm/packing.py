"""Vector bin packing of token sequences.

An example asks for three things at once: tokens, one segment, and loss-bearing tokens. A sequence has a
limit on each. Sequences are filled one at a time: of all waiting examples that fit, the one whose demand
has the largest dot product with what is left (each dimension as a share of its limit) goes in. When
none fits and cutting is allowed, one is cut to fit exactly. What is left over at the end of a task is
laid out in sequences whose lengths are powers of two, which need no padding.

Every task packs the documents it reads, so token ids are never shuffled; a task holds a bounded number
of unfinished examples (`POOL`).

Defined cases: null text counts as empty and still yields its end id; repeated rows and null ids are
packed like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import narrow, prepare, texts_of
from .tokens import word_encoder

POOL = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 1024
    loss_tokens: int = 2048


@dataclass
class Example:
    """Tokens start..stop of an owner's sequence; the last `loss` of the owner's tokens bear loss."""

    owner: object
    start: int
    stop: int
    total: int
    loss: int

    @property
    def tokens(self) -> int:
        return self.stop - self.start

    def bearing(self, stop: int | None = None) -> int:
        stop = self.stop if stop is None else stop
        return max(0, stop - max(self.start, self.total - self.loss))


@dataclass
class Placed:
    example: Example
    sequence: int
    offset: int


@dataclass
class Packer:
    """Takes examples one by one and gives back placements."""

    limits: Limits = field(default_factory=Limits)
    cut: bool = True
    pool: int = POOL
    first_sequence: int = 0

    def __post_init__(self) -> None:
        self.waiting: list[Example] = []
        self.sequence = self.first_sequence

    def _fits(self, e: Example) -> bool:
        return e.tokens <= self.limits.tokens and e.bearing() <= self.limits.loss_tokens

    def _part(self, e: Example, room: int, loss_room: int) -> int:
        """How many tokens of an example go into so much room."""
        free = max(0, e.total - e.loss - e.start)  # tokens before the loss-bearing ones
        return min(e.tokens, room, free + loss_room)

    def add(self, e: Example) -> Iterator[Placed]:
        if e.tokens <= 0:
            return
        if not self._fits(e) and not self.cut:
            raise ValueError(f"an example of {e.tokens} tokens exceeds the limits and may not be cut")
        while self.cut and (e.tokens >= self.limits.tokens or not self._fits(e)):
            n = self._part(e, self.limits.tokens, self.limits.loss_tokens)
            if n <= 0:
                raise ValueError("the limit on loss-bearing tokens leaves no room")
            yield from self._close([Example(e.owner, e.start, e.start + n, e.total, e.loss)])
            e = Example(e.owner, e.start + n, e.stop, e.total, e.loss)
        if e.tokens:
            self.waiting.append(e)
            if len(self.waiting) >= self.pool:
                yield from self.fill(self.pool // 2)

    def _close(self, chosen: list[Example]) -> Iterator[Placed]:
        offset = 0
        for e in chosen:
            yield Placed(e, self.sequence, offset)
            offset += e.tokens
        self.sequence += 1

    def fill(self, leave: int) -> Iterator[Placed]:
        """Fill sequences until at most `leave` examples wait or the rest cannot fill one."""
        lim = self.limits
        items = self.waiting
        tokens = np.array([e.tokens for e in items], np.int64)
        loss = np.array([e.bearing() for e in items], np.int64)
        there = np.ones(len(items), bool)
        scale_t, scale_s, scale_l = 1 / lim.tokens, 1 / lim.segments, 1 / lim.loss_tokens
        while there.sum() > leave:
            if leave and tokens[there].sum() < lim.tokens:
                break
            room, slots, loss_room = lim.tokens, lim.segments, lim.loss_tokens
            chosen: list[Example] = []
            while room and slots:
                able = there & (tokens <= room) & (loss <= loss_room)
                if able.any():
                    score = tokens * (scale_t * scale_t * room) + scale_s * scale_s * slots + loss * (scale_l * scale_l * loss_room)
                    k = int(np.argmax(np.where(able, score, -1.0)))
                    chosen.append(items[k])
                    there[k] = False
                    room, slots, loss_room = room - int(tokens[k]), slots - 1, loss_room - int(loss[k])
                    continue
                if not self.cut or not there.any():
                    break
                k = int(np.argmax(np.where(there, tokens, -1)))
                e = items[k]
                n = self._part(e, room, loss_room)
                if n <= 0:
                    break
                chosen.append(Example(e.owner, e.start, e.start + n, e.total, e.loss))
                items[k] = Example(e.owner, e.start + n, e.stop, e.total, e.loss)
                tokens[k], loss[k] = items[k].tokens, items[k].bearing()
                room, slots, loss_room = room - n, slots - 1, 0 if room - n else loss_room
            if room and self.cut and not there.any():
                yield from self._powers(chosen)
            else:
                yield from self._close(chosen)
        self.waiting = [e for k, e in enumerate(items) if there[k]]

    def _powers(self, chosen: list[Example]) -> Iterator[Placed]:
        """The last examples of a task in sequences whose lengths are powers of two."""
        left = sum(e.tokens for e in chosen)
        queue = list(chosen)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                e = queue.pop(0)
                n = min(size, e.tokens)
                part.append(Example(e.owner, e.start, e.start + n, e.total, e.loss))
                if n < e.tokens:
                    queue.insert(0, Example(e.owner, e.start + n, e.stop, e.total, e.loss))
                size -= n
            yield from self._close(part)

    def finish(self) -> Iterator[Placed]:
        while self.waiting:
            yield from self.fill(0)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1,
    limits: Limits = Limits(),
    with_ids: bool = False,
    loss_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    loss_col: how many of a document's last tokens bear loss, the end id included; null, and no column, means all.
    """
    prepare(docs.sparkSession)
    source = narrow(docs, doc_id=id_col, text=text_col, **({"loss": loss_col} if loss_col else {}))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        context = TaskContext.get()
        packer = Packer(limits, first_sequence=(context.partitionId() if context else 0) << 36)
        id_type = None

        def rows(placed: Iterator[Placed]) -> pa.RecordBatch | None:
            cols: list[list] = [[] for _ in range(8)]
            for p in placed:
                e = p.example
                own, ids = e.owner
                data = ids[e.start : e.stop].tobytes()
                for c, v in zip(cols, (own, e.start, e.tokens, zlib.crc32(data), e.total, p.sequence, p.offset, data), strict=True):
                    c.append(v)
            if not cols[0]:
                return None
            arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        def give(b: pa.RecordBatch) -> Iterator[Placed]:
            bearing = b.column(2).to_pylist() if loss_col else [None] * b.num_rows
            for own, data, loss in zip(b.column(0).to_pylist(), encoder.encode(texts_of(b.column(1))), bearing, strict=True):
                ids = np.append(np.frombuffer(data, encoder.dtype).astype("<u4"), np.array([end_id], "<u4"))
                loss = len(ids) if loss is None else min(max(0, loss), len(ids))
                yield from packer.add(Example((own, ids), 0, len(ids), len(ids), loss))

        for b in batches:
            id_type = b.schema.field(0).type
            if (out := rows(give(b))) is not None:
                yield out
        if id_type is not None and (out := rows(packer.finish())) is not None:
            yield out

    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return source.mapInArrow(run, schema + ", ids binary" * with_ids)
