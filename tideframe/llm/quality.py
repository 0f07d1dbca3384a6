"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose
bit b tells that rule b failed. A policy is a mask over these bits, so policies can be versioned,
applied and compared (ablations) without looking at a text again.

Defined cases: a null text counts as empty and fails the rule on few words; an empty table gives an
empty ledger; repeated rows are judged row by row; ids may be null. Texts of any length are measured
whole. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, narrow, positional, prepare, raw_texts

#: Rules in the order of their bits. A rule gets the measurements of a batch as int64 arrays.
RULES = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    ("no_words", lambda m: m["n_words"] == 0),
    ("bullets", lambda m: 10 * m["n_bullet_lines"] > 9 * m["n_lines"]),
    ("ellipses", lambda m: 10 * m["n_ellipsis_lines"] > 3 * m["n_lines"]),
    ("no_letters", lambda m: 10 * m["n_letter_words"] < 7 * m["n_words"]),
    ("top_words", lambda m: (m["n_words"] >= 50) & (100 * m["top_word"] > 30 * m["n_words"])),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
_V1 = BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"]
_LINES = BIT["bullets"] | BIT["ellipses"] | BIT["no_letters"] | BIT["top_words"]

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": BASE,
    "v1": _V1,
    # v2: and the rules on kinds of lines and words
    "v2": _V1 | _LINES,
    # v3: as v2, but a short text is no bad one; only an empty text goes for its length
    "v3": (_V1 | _LINES | BIT["no_words"]) & ~BIT["few_words"],
}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "top_word",
)
#: What a bullet line begins with, and what a line that breaks off ends with.
BULLETS = ("\u2022", "-", "*")
ELLIPSES = ("...", "\u2026")
_SYMBOLS = b"#*$%&|<>"
_OTHER_BYTES = bytes(b for b in range(256) if b not in _SYMBOLS)
#: Bytes that carry no code point of a word: ASCII white space and UTF-8 continuation bytes.
_BULLETS, _ELLIPSES = (tuple(x.encode() for x in xs) for xs in (BULLETS, ELLIPSES))
#: A word with an ASCII letter or a byte beyond ASCII counts as one with letters.
_LETTERLESS = re.compile(rb"(?<![^ \t-\r])[^A-Za-z\x80-\xff \t-\r]+(?![^ \t-\r])")
_NOT_COUNTED = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by windows of `width` words that occur at least twice in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if (int(key.max()) + 1) * len(seen) >= 2**62:  # name the prefixes so that keys stay small
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(seen) + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    put = key[order]
    equal = put[1:] == put[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """Measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text] * bool(words)
    bare = [x.strip() for x in lines]
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text.translate(None, _OTHER_BYTES)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum([x.startswith(_BULLETS) for x in bare]),
        sum([x.endswith(_ELLIPSES) for x in bare]),
        len(words) - len(_LETTERLESS.findall(text)),
        max(Counter(words).values()) if words else 0,
    )


def measure_batch(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Measurements and failed_bits of a batch."""
    table = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
    out = {name: table[:, k] for k, name in enumerate(MEASURES)}
    bits = np.zeros(len(texts), np.int64)
    for k, (_, failed) in enumerate(RULES):
        bits |= failed(out).astype(np.int64) << k
    out["failed_bits"] = bits
    return out


def quality_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measurements, and failed_bits."""
    prepare(docs.sparkSession)
    source = narrow(docs, doc_id=id_col, text=text_col)
    names = [*MEASURES, "failed_bits"]
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for b in batches:
            got = measure_batch(raw_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(got[n]) for n in names]], ["doc_id", *names])

    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def apply_policy(ledger: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept by a versioned policy."""
    bits = F.col("failed_bits")
    return ledger.withColumn("base_failed", bits.bitwiseAND(BASE) != 0).withColumn(
        "kept", bits.bitwiseAND(POLICIES[version]) == 0
    )


def ablation(ledger: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that stay without it."""
    mask = POLICIES[version]
    rules = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    failed = F.col("failed_bits").bitwiseAND(mask)
    counted = ledger.agg(
        *[F.count_if(failed.bitwiseAND(bit) != 0).alias(f"f{bit}") for _, bit in rules],
        *[F.count_if(failed == bit).alias(f"o{bit}") for _, bit in rules],
        F.count_if(failed == 0).alias("kept"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"f{bit}").alias("n_failed"),
                F.col(f"o{bit}").alias("n_failed_alone"),
                (F.col("kept") + F.col(f"o{bit}")).alias("n_kept_without"),
            )
            for name, bit in rules
        ]
    )
    return counted.select(F.inline(rows))


def keep_good(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns. One pass, no shuffle."""
    prepare(docs.sparkSession)
    at, mask = docs.columns.index(text_col), POLICIES[version]
    plain = positional(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for b in batches:
            bits = measure_batch(raw_texts(b.column(at)))["failed_bits"]
            yield b.filter(pa.array((bits & mask) == 0))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
