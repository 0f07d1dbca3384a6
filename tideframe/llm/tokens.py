"""Word tables: whole texts to token ids through public tokenizers, each distinct word once.

Byte-pair merges never cross the borders that a tokenizer's pre-tokenizer draws, so the ids of a text are
those of its words, joined by position. Every Python worker keeps a bounded table of the words it has
seen; only new ones go to the tokenizer. Words made of plain letters, digits and punctuation are cut
further and go to the tokenizer's merge model alone; all other words pass through the whole tokenizer.
"""

from __future__ import annotations

import gc
import re
from array import array
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

from .common import enter, on_leave, tokenizer_file

#: Words that a table holds in each of its two generations.
TABLE = 400_000

#: Unicode white space, as tokenizers' patterns have it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Letters of Latin-1, for which all libraries agree on case and composition.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


@contextmanager
def uncollected():
    """No garbage collection meanwhile: the lists of words hold no cycles, and tables need not be scanned."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Table:
    """A mapping that forgets what has not been used for a generation, so that its size is bounded."""

    def __init__(self, limit: int = TABLE):
        self.new: dict = {}
        self.old: dict = {}
        self.limit = limit

    def turn(self) -> None:
        """Start a new generation if the present one is full."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}

    def take(self, words: set) -> list:
        """Make sure that known words are in the new generation; return the unknown ones."""
        new, old, missing = self.new, self.old, []
        for w in words:  # not by set operations with key views, which walk through the whole table
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        return missing


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


def _holes(row: list) -> list[int]:
    """Places of None."""
    out, at = [], -1
    try:
        while True:
            at = row.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class WordEncoder:
    """Encodes texts to the ids that `Tokenizer.encode(text, add_special_tokens=False)` gives.

    Most texts are plain: Latin-1, single blanks and line feeds between words. They are cut by str.split.
    A word then stands for itself after a blank (vocabularies that drop blanks: for itself); a leading line
    feed or FIRST says that no blank comes before it. All other texts are cut by a pattern, and those
    that hold `<|`, where a special token may start, are left to the library whole.
    """

    FIRST = "\x01"

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: spaces are dropped and case is folded, or a space belongs to the next word
        self.dropping = spec.get("normalizer") is not None
        blank = "" if self.dropping else " ?"
        digits = "[0-9]" if self.dropping else "[0-9]+"
        self.inner = re.compile(f"{blank}[{_LATIN}]+|{blank}{digits}|{blank}[!-/:-@\\[-`{{-~]+")
        self.simple = re.compile(f"{blank}[{_LATIN}!-~]+")
        if self.dropping:
            self.words = re.compile("[^ \n\r\t]+")
        else:
            self.words = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+")
        size = self.whole.get_vocab_size()
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.letters = byte_letters()
        #: by word of a plain text (and by run of letters, digits or punctuation), and by chunk of another text
        self.plain, self.table = Table(), Table()

    def _split(self, text: str) -> list[str] | None:
        """The words of a plain text; None for all others."""
        for c in "\x1c\x1d\x1e\x1f\x85\xa0":
            if c in text:
                return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if self.dropping:
            return text.lower().split()
        for c in ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", self.FIRST):
            if c in text:
                return None
        words = text.replace("\n", " \n").split(" ")
        words[0] = self.FIRST + words[0]
        return words

    def _part_key(self, part: str) -> str:
        """A run's name in the table of plain words: as the word that it alone would make."""
        if self.dropping:
            return part
        return part[1:] if part[0] == " " else self.FIRST + part

    def _by_merges(self, keys: list[str]) -> None:
        """Put the ids of runs into the table of plain words."""
        if not self.dropping:
            parts = [k[1:] if k[0] == self.FIRST else " " + k for k in keys]
        else:
            parts = keys
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        found = self.merges.encode_batch_fast(mapped, add_special_tokens=False)
        for k, e in zip(keys, found, strict=True):
            self.plain.new[k] = array(self.code, e.ids).tobytes()

    def _cut(self, chunk: str) -> list[str] | None:
        """The runs that a chunk's pre-tokens are, if it is made of plain characters alone."""
        if "'" in chunk or "<|" in chunk or not self.simple.fullmatch(chunk):
            return None
        return self.inner.findall(chunk.lower() if self.dropping else chunk)

    def _learn(self, table: Table, words: list[str], plain: bool) -> None:
        cut: dict[str, list[str]] = {}
        rest: list[str] = []
        for w in words:
            before = []
            if not plain or self.dropping:
                chunk = w
            elif w[:1] == "\n":
                chunk, before = w[1:], [self.FIRST + "\n"]
            elif w[:1] == self.FIRST:
                chunk = w[1:]
            else:
                chunk = " " + w
            if plain and w.isalpha():
                cut[w] = [w]
            elif not chunk:
                cut[w] = before
            elif (parts := self._cut(chunk)) is not None:
                cut[w] = before + [self._part_key(p) for p in parts]
            else:
                rest.append(w)
        self._by_merges(self.plain.take({p for parts in cut.values() for p in parts}))
        known = self.plain.new
        for w, parts in cut.items():
            table.new[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        if rest:
            lead = {self.FIRST: 1, "\n": 0}
            chunks = rest if not plain or self.dropping else [w[lead[w[0]] :] if w[:1] in lead else " " + w for w in rest]
            for w, e in zip(rest, self.whole.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
                table.new[w] = array(self.code, e.ids).tobytes()

    def _look_up(self, table: Table, cut: list[list[str]], plain: bool) -> list[bytes]:
        for t in {id(table): table, id(self.plain): self.plain}.values():
            t.turn()
        known = table.new
        rows = [list(map(known.get, words)) for words in cut]
        holes = [(words, row, _holes(row)) for words, row in zip(cut, rows, strict=True) if None in row]
        missing = {words[k] for words, _, at in holes for k in at}
        if missing:
            self._learn(table, table.take(missing), plain)
            for words, row, at in holes:
                for k in at:
                    row[k] = known[words[k]]
        return [b"".join(row) for row in rows]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of self.dtype."""
        with uncollected():
            out: list[bytes | None] = [None] * len(texts)
            plain: dict[int, list[str]] = {}
            other: dict[int, list[str]] = {}
            for k, t in enumerate(texts):
                if "<|" in t:
                    out[k] = array(self.code, self.whole.encode(t, add_special_tokens=False).ids).tobytes()
                elif (words := self._split(t)) is not None:
                    plain[k] = words
                else:
                    other[k] = self.words.findall(t)
            for table, some in ((self.plain, plain), (self.table, other)):
                if some:
                    for k, ids in zip(some, self._look_up(table, list(some.values()), table is self.plain), strict=True):
                        out[k] = ids
            return out


class PieceEncoder:
    """SentencePiece ids and their decoding, each distinct marked word once.

    The text gets one blank in front and is cut before every run of blanks that follows something else. No
    piece of the vocabulary holds a mark after another character (checked when loaded), so no merge
    crosses a cut, and the ids of the chunks in order are the ids of the text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of this vocabulary cross white space marks")
        self.chunk = re.compile("[ ▁]+[^ ▁]*")
        self.table = Table(TABLE // 4)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids in decimal joined by commas, and the decoded text of each text."""
        with uncollected():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        self.table.turn()
        cut = [self.chunk.findall(" " + t) if t else [] for t in texts]
        missing = self.table.take(set().union(*cut))
        if missing:
            # the library puts its own mark in front, and takes it away again when it decodes
            ids = self.model.encode([w[1:] or w for w in missing], num_threads=1)
            bare = [k for k, w in enumerate(missing) if len(w) == 1]
            for k in bare:
                ids[k] = [self.model.piece_to_id("▁")]
            back = self.model.decode(ids, num_threads=1)
            for w, i, d in zip(missing, ids, back, strict=True):
                self.table.new[w] = (len(i), ",".join(map(str, i)), d)
        known = self.table.new
        out = []
        for words in cut:
            rows = [known[w] for w in words]
            out.append((sum([r[0] for r in rows]), ",".join([r[1] for r in rows]), " ".join([r[2] for r in rows])))
        return out


@lru_cache(maxsize=4)
def word_encoder(name: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary, so that its table lives on between tasks."""
    enter("words")
    return WordEncoder(tokenizer_file(name) if "/" not in name else name)


@lru_cache(maxsize=4)
def piece_encoder(name: str) -> PieceEncoder:
    enter("pieces")
    return PieceEncoder(tokenizer_file(name) if "/" not in name else name)


on_leave("words", word_encoder.cache_clear)
on_leave("pieces", piece_encoder.cache_clear)
