"""Word shingles as 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

from lumenark.llm.common import FOLD, WORD_BYTE, text_bytes

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = [np.uint64(x | 1) for x in _RNG.integers(0, 2**63, 64, dtype=np.uint64).tolist()]
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and each text's offset in them.

    Words are runs of digits, letters and non-ASCII characters, A-Z folded. The hash of a word is a
    difference of prefix sums, so one pass covers all words of a batch.
    """
    raw, offsets = text_bytes(column)
    n = len(raw)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = WORD_BYTE[raw]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | fresh))
    ends = np.flatnonzero(before & (~inside | fresh))
    up, down = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[FOLD[raw]] * up)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words than ``width`` is one shingle, one of none has none."""
    words, at = word_hashes(column)
    joined = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        joined[: max(len(words) - k, 0)] += words[k:] * _STEP[k]
    joined = mix(joined)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(joined[a: b - width + 1]))
        elif b > a:
            steps = np.array(_STEP[: b - a], dtype=np.uint64)
            out.append(mix((words[a:b] * steps).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
