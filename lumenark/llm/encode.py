"""Exact BPE encoding by the ``tokenizers`` library with a bounded cache of chunks.

A text is the concatenation of chunks that the tokenizer can never join: its pre-tokenizer has a
boundary before every single space between two non-space characters, and around a single newline
between two. Chunks repeat, so each worker keeps their ids; a text whose white space is not of
that plain kind is encoded over longer chunks, which is as exact and slower. Of a column of texts
each distinct chunk is looked up once; its ids are then gathered for all its occurrences.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

from lumenark.llm.common import WORKER

#: Letters of one byte or two in UTF-8 that both tokenizers keep together and lower-case alike.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII punctuation without the apostrophe, which opens contractions, and without angle brackets and bars, which write special tokens.
_PUNCTUATION = re.compile(r'[.,!?#$%&*;:()\[\]"/=+-]+')
_PLAIN = re.compile(f"({_LETTERS.pattern})({_PUNCTUATION.pattern})?")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")


class _Irregular(Exception):
    pass


#: Longer chunks are not kept: texts without spaces are one chunk each.
_KEPT_LENGTH = 64


class _Cache(dict):
    """Two generations: what was used since the last turn survives it, so memory stays bounded."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _KEPT_LENGTH:
                return value
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _distinct(values: list[str], make: Callable[[str], bytes]) -> tuple[list[bytes], list[int]]:
    """Ids of every value, and the places of irregular ones, which have none."""
    try:
        return list(map(make, values)), []
    except _Irregular:
        out, irregular = [], []
        for i, value in enumerate(values):
            try:
                out.append(make(value))
            except _Irregular:
                out.append(b"")
                irregular.append(i)
        return out, irregular


class Chunks:
    """The texts of an Arrow column cut at single spaces, each distinct chunk once."""

    def __init__(self, column):
        import pyarrow.compute as pc

        self.texts = pc.fill_null(column, "")
        lists = pc.split_pattern(self.texts, " ")
        self.at = lists.offsets.to_numpy().astype(np.int64)  # every text has one chunk at least
        coded = lists.flatten().dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy(), coded.dictionary

    def encode(self, inner: Callable[[str], bytes], whole: Callable[[str], bytes], first: Callable[[str], bytes] | None = None,
               end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them): ``inner`` of each chunk, ``first`` of a text's first one if it differs, then ``end``.

        Texts with a chunk that raises ``_Irregular`` are encoded by ``whole``.
        """
        n, at = len(self.texts), self.at
        heads, row = at[:-1], np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        codes = self.codes.astype(np.int32)
        irregular = np.zeros(n, dtype=bool)
        if first is None:
            asked, values = self.distinct.to_pylist(), []
        else:
            within = np.ones(len(codes), dtype=bool)
            within[heads] = False
            used = np.zeros(len(self.distinct), dtype=bool)
            used[codes[within]] = True
            asked = self.distinct.filter(used).to_pylist()
            values, odd = _distinct(self.distinct.take(self.codes[heads]).to_pylist(), first)
            irregular[odd] = True
            codes = np.where(within, (np.cumsum(used) - 1)[codes] + n, row).astype(np.int32)
        known, odd = _distinct(asked, inner)
        if odd:
            flag = np.zeros(len(values) + len(known), dtype=bool)
            flag[np.array(odd) + len(values)] = True
            irregular[row[flag[codes]]] = True
        values += known
        again = np.flatnonzero(irregular)
        if len(again):
            codes[irregular[row]] = len(values) + len(again)
            codes[heads[again]] = len(values) + np.arange(len(again))
            values += [whole(self.texts[i].as_py()) for i in again.tolist()] + [b""]
        if end:
            placed = np.full(len(codes) + n, len(values), dtype=np.int32)
            placed[np.arange(len(codes)) + row] = codes
            codes, at = placed, at + np.arange(n + 1)
            values.append(end)
        size = np.fromiter((len(v) // 4 for v in values), dtype=np.int32, count=len(values))
        pool, start = np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(size) - size
        size = size[codes]
        ends = np.cumsum(size)
        place = np.repeat(start[codes] - ends + size, size)
        place += np.arange(len(place))
        return pool[place], np.concatenate([[0], ends])[at]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, room: int = 300_000, words: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = str(spec["pre_tokenizer"]) + str(spec["normalizer"])
        self.lower = "Lowercase" in kinds
        self.spaced = not self.lower  # a space belongs to the word after it, or is dropped
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self.words = _Cache(self._word, words or room // 8)
        self.inner = _Cache(self._inner, room)
        self.first = _Cache(lambda c: self._chunk(c, False), room // 8)
        self.wide = _Cache(self._whole, room // 8)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _word(self, word: str) -> bytes:
        """Ids of one run of letters, perhaps after a space."""
        if word.isascii():
            shown = word.replace(" ", self.letters[32])
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.four[t.id] for t in self.model.tokenize(shown)])

    def _part(self, part: str, spaced: bool) -> bytes:
        m = _PLAIN.fullmatch(part)
        if not m:
            return self.wide[" " + part if spaced and self.spaced else part]
        word = m[1].lower() if self.lower else m[1]
        out = self.words[" " + word if spaced and self.spaced else word]
        return out + self.wide[m[2]] if m[2] else out

    def _chunk(self, chunk: str, spaced: bool) -> bytes:
        parts = chunk.split("\n")
        if self.spaced and (len(parts) > 1 or not chunk.isascii() or not chunk.isprintable()):
            if any(not p or p != "".join(p.split()) for p in parts):
                raise _Irregular
        elif self.spaced and not chunk:
            raise _Irregular
        out = [self._part(parts[0], spaced)] if parts[0] else []
        for part in parts[1:]:
            if self.spaced:
                out.append(self.wide["\n"])
            if part:
                out.append(self._part(part, False))
        return b"".join(out)

    def _inner(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii():
            return self.words[chunk.lower() if self.lower else " " + chunk]
        m = _PLAIN.fullmatch(chunk)
        if m is None:
            return self._chunk(chunk, True)
        word, tail = m.groups()
        out = self.words[word.lower() if self.lower else " " + word]
        return out + self.wide[tail] if tail else out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = text.split(" ")
        try:
            head = self.first[chunks[0]]
            return head + b"".join(map(self.inner.__getitem__, chunks[1:])) if len(chunks) > 1 else head
        except _Irregular:
            return b"".join(map(self.wide.__getitem__, _BOUNDARY.split(text)))

    def encode_column(self, column, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): of each text of an Arrow column what ``encode`` gives, and ``end``."""
        if not self.spaced:  # drops newlines like spaces
            import pyarrow.compute as pc

            return Chunks(pc.replace_substring(column, "\n", " ")).encode(self.inner.__getitem__, self.encode, end=end)
        return Chunks(column).encode(self.inner.__getitem__, self.encode, self.first.__getitem__, end)


STATE = "encoder"


def encoder(path: str, **rooms: int) -> Encoder:
    """One encoder per Python worker: the one of the vocabulary file and rooms asked for last."""
    kept = WORKER.get(STATE)
    if kept is None or kept[0] != (path, rooms):
        WORKER[STATE] = kept = ((path, rooms), Encoder(path, **rooms))
    return kept[1]
