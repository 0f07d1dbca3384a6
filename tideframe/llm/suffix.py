"""Exact removal of long repeated strings with two-stage suffix sorting.

A byte is removed if a string of `window` bytes that covers it starts at any other place of the corpus,
in the same document or in another. Strings never cross documents and are judged on the input. The same engine
finds strings of a number of words that occur again: a text is then read as the string of its words' 32-bit codes
(words split at ASCII white space; how much of it stands between them does not count).

Sorting every suffix of a corpus in one place is impossible, so the suffixes are dealt out such that equal
windows always meet:

1. Each window has an anchor, its smallest (leftmost) hashed k-gram. Runs of starts that share an anchor
   and a half of the distances to it form a piece; all windows of a piece contain a common core. Equal
   windows have equal cores, and only pieces whose core occurs again go on.
2. Equal pieces are aggregated before they are moved; one stands for all, with its number of copies. A piece that
   has copies repeats whole. A core of which all pieces are equal is settled by that, without a look at its text.
3. The pieces of a core are laid out in a block of text. There the suffixes smaller than their successors
   are sorted directly, the others are induced by scanning the buckets of first bytes in order, and
   common prefixes of neighbours tell which windows repeat.
4. A core with more than `HOT` different pieces (a line or passage that very many documents share) is dealt out
   again by ranges of the distance to the anchor: the windows of a narrower range share a longer core, and equal
   windows have equal distances, so they still meet. Where the range is one distance, the core is the whole window
   and all its pieces are equal. So blocks stay small whatever is common, and nothing is dropped.

Defined cases: null text counts as empty; texts shorter than the window lose nothing; a text that occurs
twice, also as a repeated row, is removed whole if it has `window` bytes; null ids are kept; an empty
table gives an empty result; extra columns are ignored, or kept where the result has the input's columns.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, narrow, on_leave, positional, prepare, raw_texts, scratch
from .simhash import fresh, row_keys

WINDOW = 400
#: Different pieces of one core that are sorted in one block: about 140 kB of text.
HOT = 256
#: Bytes of a word's code.
CODE = 4
#: A core is 63 bits and, in front, one that tells strings of words (as a long: negative) from those of bytes.
LOW, WORDS = (1 << 63) - 1, 1 << 63
#: Starts that one vectorised pass looks at, and bytes of one block that is sorted.
SEGMENT = 1 << 20
BLOCK = 1 << 19

_U = np.uint64
_IN_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)], np.int8)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word per byte, and powers of the base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(11)
    word = rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    n = SEGMENT + (1 << 16)
    power, back = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    power[0] = back[0] = 1
    return word, np.multiply.accumulate(power), np.multiply.accumulate(back)


on_leave("suffix", _tables.cache_clear)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of the k units (bytes or codes of words) at every place."""
    word, power, back = _tables()
    total = np.zeros(len(data) + 1, _U)
    value = word[data] if data.dtype == np.uint8 else data.astype(_U) * _U(0xC2B2AE3D27D4EB4F) | _U(1)
    np.cumsum(value * power[: len(data)], out=total[1:])
    return _mix((total[k:] - total[:-k]) * back[: len(data) - k + 1])


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return h


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    edge = np.diff(np.concatenate([[0], _IN_WORD[np.frombuffer(text, np.uint8)], [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_codes(text: bytes) -> bytes:
    """The codes of a text's words, CODE bytes each."""
    start, end = word_places(text)
    word, power, back = _tables()
    data = np.frombuffer(text, np.uint8)
    out = np.zeros(len(start), _U)
    first = 0
    while first < len(start):
        base = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, base + len(power), "right")))
        if end[first] - base > len(power):  # one word that no table reaches over
            out[first] = xxhash.xxh3_64_intdigest(text[base : end[first]])
        else:
            total = np.zeros(int(end[last - 1]) - base + 1, _U)
            np.cumsum(word[data[base : end[last - 1]]] * power[: len(total) - 1], out=total[1:])
            lo, hi = start[first:last] - base, end[first:last] - base
            out[first:last] = _mix((total[hi] - total[lo]) * back[lo])
        first = last
    return (out >> _U(32)).astype("<u4").tobytes()


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each run of `width` values."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    table = np.full(rows * width, _U(2**64 - 1))
    table[: len(h)] = h
    table = table.reshape(rows, width)
    place = np.arange(rows * width).reshape(rows, width)
    low = np.minimum.accumulate(table, axis=1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] < low[:, :-1]
    low_at = np.maximum.accumulate(np.where(new, place, 0), axis=1).ravel()
    high = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]
    high_at = np.minimum.accumulate(np.where(table == high, place, rows * width)[:, ::-1], axis=1)[:, ::-1].ravel()
    low, high = low.ravel(), high.ravel()
    first, last = slice(0, n), slice(width - 1, width - 1 + n)
    return np.where(high[first] <= low[last], high_at[first], low_at[last])


def shape(window: int) -> tuple[int, int]:
    """Length of the anchors' k-grams and number of starts of a piece at most, for a window."""
    k = max(2, min(64, window // 4))
    return k, -(-(window - k + 1) // 2)


def anchors(data: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of some units, and the first and last start of the windows that each is the anchor of.

    A window's anchor is the leftmost smallest gram of a sample that goes by the hash, or of all grams if none of the
    sample is in the window. Only where that happens are all grams looked at.
    """
    width = window - k + 1
    h = gram_hashes(data, k)
    n = len(h) - width + 1
    sparse = (1 << max(0, (width // 20).bit_length() - 1)) - 1
    at = np.flatnonzero((h & _U(sparse)) == 0)
    if len(at) and at[0] < width and at[-1] >= n - 1 and (np.diff(at) <= width).all():
        value = h[at]
        before, after = np.full(len(at), -1), np.full(len(at), len(h) + width)
        for side, found in ((-1, before), (1, after)):
            open_ = np.arange(len(at))
            step = 0
            while len(open_):
                step += side
                open_ = open_[(open_ >= -step) if side < 0 else (open_ < len(at) - step)]
                other = open_ + step
                near = np.abs(at[open_] - at[other]) < width
                open_, other = open_[near], other[near]
                hit = value[other] <= value[open_] if side < 0 else value[other] < value[open_]
                found[open_[hit]] = at[other[hit]]
                open_ = open_[~hit]
        low = np.maximum(np.maximum(at - width + 1, before + 1), 0)
        high = np.minimum(np.minimum(at, after - width), n - 1)
        some = low <= high
        return at[some], low[some], high[some]
    outside = ((h & _U(sparse)) != 0).astype(_U) << _U(63)
    anchor = leftmost_minimum(h >> _U(1) | outside, width)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    low = np.concatenate([[0], cut])
    return anchor[low], low, np.concatenate([cut, [len(anchor)]]) - 1


def units(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The units of some texts on end, and where each text's begin and the last's end."""
    size = np.cumsum([0, *[len(t) + words for t in texts]])
    if not words:
        return np.frombuffer(b"".join(texts), np.uint8), size
    joined = b"\n".join(texts)
    return np.frombuffer(word_codes(joined), "<u4"), np.searchsorted(word_places(joined)[0], size)


def pieces(texts: list[bytes], window: int, words: bool = False) -> Iterator[tuple[np.ndarray, list[int], list[int], np.ndarray]]:
    """(number of the text, core, digest, place) of the pieces of some texts, many at a time; window and places in units.

    Each start is in one piece.
    """
    k, part = shape(window)
    data, edge = units(texts, words)
    unit, sign = (CODE, WORDS) if words else (1, 0)
    raw = memoryview(data).cast("B") if len(data) else b""
    digest = xxhash.xxh3_64_intdigest
    cuts = [(i, at, lo + at, min(lo + at + SEGMENT + window - 1, hi)) for i, (lo, hi) in enumerate(itertools.pairwise(edge.tolist())) for at in range(0, hi - lo - window + 1, SEGMENT)]
    while cuts:
        base = cuts[0][2]
        many = 1
        while many < len(cuts) and cuts[many][3] - base <= SEGMENT + (1 << 15) and cuts[many][0] != cuts[many - 1][0]:
            many += 1
        now, cuts = np.array(cuts[:many], np.int64), cuts[many:]
        anchor, first, last = anchors(data[base : now[-1, 3]], k, window)
        anchor, first, last = anchor + base, first + base, last + base
        # a window of one text has its anchor in that text
        of = np.maximum(np.searchsorted(now[:, 2], anchor, "right") - 1, 0)
        first, last = np.maximum(first, now[of, 2]), np.minimum(last, now[of, 3] - window)
        for half in (0, 1):
            # all starts of a half are at anchor - part * (half + 1) + 1 ... anchor - part * half
            right = anchor - part * half
            left = np.maximum(right - part + 1, anchor - (window - k))
            low, high = np.maximum(first, right - part + 1), np.minimum(last, right)
            some = low <= high
            right, left, low, high, own = right[some], left[some], low[some], high[some], of[some]
            place = (low - now[own, 2] + now[own, 1]) << 32 | (right - low) << 16 | high - low + 1
            columns = (right * unit, (left + window) * unit, low * unit, (high + window) * unit)
            ends = [c.tolist() for c in columns]
            core = [digest(raw[r:m], half) & LOW | sign for r, m in zip(ends[0], ends[1], strict=True)]
            piece = [digest(raw[lo:hi], 2) for lo, hi in zip(ends[2], ends[3], strict=True)]
            yield now[own, 0], core, piece, place


def opened(place: int) -> tuple[int, int, int]:
    """First start, distance from it to the last start that the piece's range could hold, number of starts."""
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def narrower(text: bytes, window: int, unit: int, core: int, place: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(core, digest, place, offset in the piece) of the parts of a piece by ranges of `width` distances."""
    lo, reach, n = opened(place)
    last = lo + reach
    for q in range((reach - n + 1) // width, reach // width + 1):
        right = last - q * width
        a, b = max(lo, right - width + 1), min(lo + n - 1, right)
        own = xxhash.xxh3_64_intdigest(text[right * unit : (right - width + 1 + window) * unit], core + q & 0xFFFFFFFFFFFFFFFF)
        yield own & LOW | (WORDS if core < 0 else 0), xxhash.xxh3_64_intdigest(text[a * unit : (b + window) * unit], 2), a << 32 | (right - a) << 16 | b - a + 1, a - lo


class Block:
    """Two-stage suffix sorting of the first starts of some strings, by `window` bytes; only every `unit`th start counts."""

    def __init__(self, strings: list[bytes], starts: list[int], window: int, unit: int = 1):
        self.text = b"".join(strings)
        self.window = window
        t = np.frombuffer(self.text, np.uint8)
        n = len(t)
        # smaller[i]: the suffix at i is smaller than the one at i + 1; the end counts as the smallest
        step = np.zeros(n, np.int8)
        step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
        step[-1] = -1
        known = np.where(step != 0, np.arange(n), n)
        following = np.minimum.accumulate(known[::-1])[::-1]
        self.smaller = step[following] > 0
        self.t = t
        # wanted starts of each string, then on to the next suffix that is sorted directly
        base = np.concatenate([[0], np.cumsum([len(s) for s in strings])[:-1]]).astype(np.int64)
        many = np.array(starts, np.int64)
        next_small = np.minimum.accumulate(np.where(self.smaller, np.arange(n), n - 1)[::-1])[::-1]
        stop = next_small[base + many - 1] + 1
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, base, 1)
        np.add.at(edge, stop, -1)
        self.inside = np.cumsum(edge[:-1]) > 0
        edge[:] = 0
        np.add.at(edge, base, 1)
        np.add.at(edge, base + many, -1)
        self.wanted = np.cumsum(edge[:-1]) > 0
        if unit > 1:  # all strings have whole units, so places count from the block's start
            self.wanted &= np.arange(n) % unit == 0
        self.base = base

    def sort(self) -> np.ndarray:
        """The suffixes of `inside` in order of their first `window` bytes."""
        t, window, text = self.t, self.window, self.text.decode("latin-1")
        last = len(t) - 1
        direct = self.inside & self.smaller
        at = np.flatnonzero(direct)
        at = at[np.argsort(t[at], kind="stable")]
        bound = np.searchsorted(t[at], np.arange(257))
        induced = self.inside & ~direct
        induced[last] = False
        bucket: list[list[np.ndarray]] = [[] for _ in range(256)]
        if self.inside[last]:  # the last suffix has no successor to be induced from; it leads its bucket
            bucket[t[last]].append(np.array([last]))
        out: list[np.ndarray] = []
        for c in range(256):
            first = np.concatenate(bucket[c]) if bucket[c] else np.zeros(0, np.int64)
            scan = [first]
            while len(first):  # suffixes of this bucket that the bucket itself induces
                before = first[first > 0] - 1
                first = before[induced[before] & (t[before] == c)]
                scan.append(first)
            own = sorted(at[bound[c] : bound[c + 1]].tolist(), key=lambda p: text[p : p + window])
            scan.append(np.array(own, np.int64))
            here = np.concatenate(scan)
            if not len(here):
                continue
            out.append(here)
            before = here[here > 0] - 1
            before = before[induced[before] & (t[before] > c)]
            if len(before):
                char = t[before]
                order = np.argsort(char, kind="stable")
                before, char = before[order], char[order]
                cut = np.flatnonzero(char[1:] != char[:-1]) + 1
                for group in np.split(before, cut):
                    bucket[t[group[0]]].append(group)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def repeated(self) -> np.ndarray:
        """For each place, whether the window that starts there is wanted and equals another wanted one."""
        order = self.sort()
        order = order[self.wanted[order]]
        padded = np.concatenate([self.t, np.zeros(8, np.uint8)])
        words = np.ascontiguousarray(np.ndarray((len(self.t) + 1,), "<u8", padded.tobytes(), strides=(1,)))
        a, b = order[:-1], order[1:]
        pair = np.arange(len(a))
        steps = [*range(0, self.window - 7, 8)] if self.window >= 8 else []
        if self.window % 8 and self.window >= 8:
            steps.append(self.window - 8)
        for s in steps:  # common prefixes of neighbours, eight bytes at a time
            pair = pair[words[a[pair] + s] == words[b[pair] + s]]
        if self.window < 8:
            mask = _U((1 << (8 * self.window)) - 1)
            pair = pair[(words[a] & mask) == (words[b] & mask)]
        out = np.zeros(len(self.t), bool)
        out[a[pair]] = True
        out[b[pair]] = True
        return out


def runs(flags: np.ndarray) -> np.ndarray:
    """(start, length) of the runs of true flags, as one flat int32 array."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return np.stack([start, np.flatnonzero(edge == -1) - start], axis=1).astype("<i4").ravel()


def repeated_in(rows: list[tuple], window: int, unit: int) -> Iterator[tuple]:
    """(core, piece, starts, runs) of rows (core, piece, copies, starts, bytes) whose cores are all here whole.

    Runs are None where all starts repeat, as those of a piece with copies do.
    """
    block = Block([r[4] for r in rows], [(r[3] - 1) * unit + 1 for r in rows], window * unit, unit)
    found = block.repeated()
    for base, (core, piece, copies, n, _) in zip(block.base.tolist(), rows, strict=True):
        flags = found[base : base + n * unit : unit]
        if copies > 1 or flags.all():
            yield core, piece, n, None
        elif flags.any():
            yield core, piece, n, runs(flags).tobytes()


@dataclass(frozen=True)
class Search:
    """What is looked for: strings of `window` bytes, of `words` words, or both at once."""

    window: int | None = WINDOW
    words: int | None = None

    def of(self, core: int) -> tuple[int, int]:
        """Window in units, and bytes of a unit, of a core's strings."""
        return (self.words, CODE) if core < 0 else (self.window, 1)


class Streams:
    """What a text is searched as: its bytes, and its words' codes where they are asked for."""

    def __init__(self, text: bytes):
        self.text, self.codes = text, None

    def of(self, core: int) -> bytes:
        if core >= 0:
            return self.text
        if self.codes is None:
            self.codes = word_codes(self.text)
        return self.codes


def repeated_starts(docs: DataFrame, search: Search) -> DataFrame:
    """(k1, k2, found) of a table (k1, k2, text); found lists (words, start, n, runs): of n starts from there, those that repeat.

    Starts are in bytes, or in words where the flag `words` is set. runs: see repeated_in.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix")
        names = ["core", "piece", "k1", "k2", "at"]
        for b in batches:
            texts = raw_texts(b.column(2))
            for window, words in ((search.window, False), (search.words, True)):
                for who, core, piece, at in pieces(texts, window, words) if window is not None else ():
                    own = pa.array(who)
                    longs = [pa.array(np.array(x, _U).view(np.int64)) for x in (core, piece)]
                    yield pa.RecordBatch.from_arrays([*longs, b.column(0).take(own), b.column(1).take(own), pa.array(at)], names)

    every = docs.mapInArrow(cut, "core bigint, piece bigint, k1 bigint, k2 bigint, at bigint")
    again = every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select(fresh("core"))
    where = scratch(spark, "pieces")
    every.join(again, "core", "left_semi").write.parquet(where)
    found = spark.read.parquet(where)
    kinds = found.groupBy("core", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "at")).alias("one"))

    def fetch(some: DataFrame) -> DataFrame:
        """The strings of pieces: each text once, whatever its number of pieces."""
        lists = some.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("core", "piece", "copies", "n_kinds", "one.at")).alias("own"))
        joined = docs.join(lists.select(fresh("k1"), "k2", "own"), ["k1", "k2"]).select("k1", "k2", "text", "own")
        return joined.mapInArrow(take, STRINGS)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix")
        out: list[tuple] = []
        last = None
        for b in batches:
            for k1, k2, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                if (k1, k2) == last:  # rows that occur twice follow each other
                    continue
                last, streams = (k1, k2), Streams(text)
                for p in own:
                    lo, reach, n = opened(p["at"])
                    window, unit = search.of(p["core"])
                    data = streams.of(p["core"])[lo * unit : (lo + n - 1 + window) * unit]
                    out.append((p["core"], p["piece"], p["copies"], p["n_kinds"], reach << 16 | n, data))
                if len(out) >= 4096:
                    yield _batch(out, _STRINGS)
                    out = []
        if out:
            yield _batch(out, _STRINGS)

    width = max(shape(x)[1] for x in (search.window, search.words) if x is not None)
    verdict = _settle(kinds, fetch, search, width)
    verdict = verdict.select(fresh("core"), "piece", "off", "n", "runs")
    hit = F.struct((F.col("core") < 0).alias("words"), (F.shiftright("at", 32) + F.col("off")).alias("start"), "n", "runs").alias("hit")
    return found.join(verdict, ["core", "piece"]).select("k1", "k2", hit).groupBy("k1", "k2").agg(F.collect_set("hit").alias("found"))


STRINGS = "core bigint, piece bigint, copies bigint, n_kinds bigint, at bigint, data binary"
_STRINGS = pa.schema([*[(n, pa.int64()) for n in ("core", "piece", "copies", "n_kinds", "at")], ("data", pa.binary())])
_SORTED = pa.schema([("core", pa.int64()), ("piece", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("runs", pa.binary())])
_PARTS = pa.schema([(n, pa.int64()) for n in ("core", "piece", "off", "core2", "piece2", "copies", "at")])


def _settle(kinds: DataFrame, fetch: Callable[[DataFrame], DataFrame], search: Search, width: int) -> DataFrame:
    """(core, piece, off, n, runs): what repeats of each different piece (core, piece, copies, one) of the cores.

    one: where a piece's string is found, by `fetch`, and its place `at`. One piece may have several rows: of its n
    starts from off on, those of the runs. width: distances to the anchor that a piece may span.
    """
    spark = kinds.sparkSession
    many = kinds.groupBy("core").agg(F.count("*").alias("n_kinds")).select(fresh("core"), "n_kinds")
    where = scratch(spark, "kinds")
    kinds.join(many, "core").write.parquet(where)
    kinds = spark.read.parquet(where)
    whole = kinds.where("n_kinds = 1").select(
        "core", "piece", F.lit(0).alias("off"), F.col("one.at").bitwiseAND(0xFFFF).cast("int").alias("n"), F.lit(None).cast("binary").alias("runs")
    )
    where = scratch(spark, "strings")
    fetch(kinds.where("n_kinds > 1")).write.parquet(where)
    strings = spark.read.parquet(where)

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole cores of one kind of string are gathered until a block is full; the rows come sorted by core."""
        enter("suffix")
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return _batch([(c, p, 0, n, r) for c, p, n, r in repeated_in(rows, *search.of(rows[0][0]))], _SORTED)

        for b in batches:
            for core, piece, copies, place, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (core, piece) == held[-1][:2]:
                    continue  # a document row that occurs twice
                if held and ((size >= BLOCK and core != held[-1][0]) or (core < 0) != (held[-1][0] < 0)):
                    yield flush(held)
                    held, size = [], 0
                held.append((core, piece, copies, place & 0xFFFF, data))
                size += len(data)
        if held:
            yield flush(held)

    usual = strings.where(f"n_kinds <= {HOT}").select("core", "piece", "copies", "at", "data")
    usual = usual.repartition("core").sortWithinPartitions("core", "piece").mapInArrow(sort_blocks, "core bigint, piece bigint, off int, n int, runs binary")
    verdict = whole.unionByName(usual)
    hot = strings.where(f"n_kinds > {HOT}")
    if hot.isEmpty():
        return verdict

    finer = max(1, width // 8)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix")
        for b in batches:
            out = []
            for core, piece, copies, _, place, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for core2, piece2, at, off in narrower(data, *search.of(core), core, place, finer):
                    out.append((core, piece, off, _signed(core2), _signed(piece2), copies, at))
            yield _batch(out, _PARTS)

    where = scratch(spark, "parts")
    hot.mapInArrow(refine, ", ".join(f"{n} bigint" for n in _PARTS.names)).distinct().write.parquet(where)
    parts = spark.read.parquet(where)
    again = parts.groupBy("core2").agg(F.sum("copies").alias("n")).where("n > 1").select(fresh("core2"))
    parts = parts.join(again, "core2", "left_semi")
    below = parts.groupBy("core2", "piece2").agg(F.sum("copies").alias("copies"), F.min(F.struct(F.col("core").alias("of"), F.col("piece").alias("ofp"), "off", "at")).alias("one"))
    below = below.select(F.col("core2").alias("core"), F.col("piece2").alias("piece"), "copies", "one")

    def slices(some: DataFrame) -> DataFrame:
        wanted = some.select("core", "piece", "copies", "n_kinds", "one.*")
        held = hot.select(fresh("core").alias("of"), F.col("piece").alias("ofp"), "data")
        return wanted.join(held, ["of", "ofp"]).select("core", "piece", "copies", "n_kinds", "at", "off", "data").mapInArrow(slice_, STRINGS)

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for core, piece, copies, n_kinds, place, off, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                window, unit = search.of(core)
                n = place & 0xFFFF
                out.append((core, piece, copies, n_kinds, place & 0xFFFFFFFF, data[off * unit : (off + n - 1 + window) * unit]))
            yield _batch(out, _STRINGS)

    below = _settle(below, slices, search, finer)
    below = below.select(fresh("core").alias("core2"), F.col("piece").alias("piece2"), F.col("off").alias("more"), "n", "runs")
    up = parts.select("core", "piece", "off", "core2", "piece2").join(below, ["core2", "piece2"])
    return verdict.unionByName(up.select("core", "piece", (F.col("off") + F.col("more")).cast("int").alias("off"), "n", "runs"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Found:
    """A batch's column of what repeated_starts lists, by row."""

    def __init__(self, column: pa.Array, search: Search):
        self.search = search
        self.edge = column.offsets.to_numpy()
        self.any = np.diff(self.edge) * np.asarray(column.is_valid()) > 0
        hit = column.values
        self.words, self.start, self.n = (hit.field(k).to_numpy(zero_copy_only=False) for k in ("words", "start", "n"))
        self.runs = hit.field("runs")
        self.part = np.asarray(self.runs.is_valid())

    def starts(self, row: int, words: bool, size: int) -> np.ndarray:
        """Which of a row's units are covered by the strings that repeat."""
        window = self.search.words if words else self.search.window
        own = slice(self.edge[row], self.edge[row + 1])
        mine = self.words[own] == words
        low, n, part = self.start[own][mine], self.n[own][mine].astype(np.int64), self.part[own][mine]
        edge = np.zeros(size + 1, np.int32)
        np.add.at(edge, low[~part], 1)
        np.add.at(edge, (low + n)[~part] - 1 + window, -1)
        for k in (np.flatnonzero(mine)[part] + self.edge[row]).tolist():
            r = np.frombuffer(self.runs[k].as_buffer(), "<i4").reshape(-1, 2).astype(np.int64)
            np.add.at(edge, self.start[k] + r[:, 0], 1)
            np.add.at(edge, self.start[k] + r[:, 0] + r[:, 1] - 1 + window, -1)
        return np.cumsum(edge[:-1]) > 0

    def bytes(self, row: int, text: bytes) -> np.ndarray:
        """Bytes covered by repeated strings of bytes."""
        return self.starts(row, False, len(text))

    def passages(self, row: int, text: bytes) -> np.ndarray:
        """Bytes covered by repeated strings of words, with the white space between these."""
        edge = np.zeros(len(text) + 1, np.int32)
        if self.words[self.edge[row] : self.edge[row + 1]].any():
            start, end = word_places(text)
            span = runs(self.starts(row, True, len(start))).reshape(-1, 2)
            edge[start[span[:, 0]]] += 1
            edge[end[span[:, 0] + span[:, 1] - 1]] -= 1
        return np.cumsum(edge[:-1]) > 0


def _with_found(docs: DataFrame, id_col: str, text_col: str, search: Search) -> DataFrame:
    """All columns under plain names, then `found`: what repeated_starts lists."""
    prepare(docs.sparkSession)
    keys = narrow(docs, doc_id=id_col, text=text_col)
    spans = repeated_starts(keys.select(*row_keys(F.col("doc_id"), F.col("text")), "text"), search)
    plain = positional(docs)
    own = row_keys(*[plain[f"_c{docs.columns.index(c)}"] for c in (id_col, text_col)])
    joined = plain.select("*", *own).join(spans.select(fresh("k1"), "k2", "found"), ["k1", "k2"], "left")
    return joined.select(*plain.columns, "found")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: int | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, length of the removed runs), and of strings of
    `words` words that occur again, which are not removed: n_passage_bytes, n_passages (maximal runs of these bytes).
    """
    search = Search(window, words)
    joined = _with_found(narrow(docs, doc_id=id_col, text=text_col), "doc_id", "text", search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix")
        for b in batches:
            out = []
            found = Found(b.column(2), search)
            for i, t in enumerate(raw_texts(b.column(1))):
                if not found.any[i]:
                    out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), [], 0, 0))
                    continue
                said = found.passages(i, t)
                more = (int(said.sum()), len(runs(said)) // 2)
                gone = found.bytes(i, t)
                span = runs(gone).reshape(-1, 2).tolist()
                rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((len(t), int(gone.sum()), len(span), hashlib.sha256(rest).hexdigest(), [{"start": s, "length": n} for s, n in span], *more))
            yield _batch([(i, *r) for i, r in zip(b.column(0).to_pylist(), out, strict=True)], pa.schema([b.schema.field(0).with_name("doc_id"), *schema]))

    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = [*[pa.field(n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")], pa.field("kept_sha256", pa.string()), pa.field("spans", spans)]
    schema += [pa.field(n, pa.int64()) for n in ("n_passage_bytes", "n_passages")]
    kind = dict(joined.dtypes)["_c0"]
    return joined.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "spans array<struct<start:bigint,length:bigint>>, n_passage_bytes bigint, n_passages bigint",
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", window: int = WINDOW, words: int | None = None
) -> DataFrame:
    """The documents with the repeated strings cut out of their texts, and size_col brought up to date.

    With `words`, strings of that many words that occur again go too, however few bytes they have. Only whole characters
    are cut, so that the rest stays valid UTF-8.
    """
    search = Search(window, words)
    joined = _with_found(docs, id_col, text_col, search)
    n_cols = len(docs.columns)
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix")
        for b in batches:
            found = Found(b.column(n_cols), search)
            cols = list(b.columns[:n_cols])
            if found.any.any():
                texts = b.column(at).to_pylist()
                sizes = b.column(size_at).to_pylist() if size_at is not None else None
                for i in np.flatnonzero(found.any).tolist():
                    if texts[i] is not None:
                        raw = texts[i].encode()
                        texts[i] = cut_out(raw, found.bytes(i, raw) | found.passages(i, raw))
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                cols[at] = pa.array(texts, b.column(at).type)
                if sizes is not None:
                    cols[size_at] = pa.array(sizes, b.column(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, list(b.schema.names[:n_cols]))

    plain = joined.drop("found")
    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)


def cut_out(text: bytes, gone: np.ndarray) -> str:
    """The text without those characters of which every byte is gone."""
    data = np.frombuffer(text, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, lead)
    return data[~np.repeat(whole, np.diff(np.concatenate([lead, [len(data)]])))].tobytes().decode()
