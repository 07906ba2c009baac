"""The automaton counts what greedy longest-match cuts."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from lumenark.llm import wordpiece as W


def greedy(word: bytes, starts: set, inner: set) -> int:
    n, at = 0, 0
    while at < len(word):
        pool = starts if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("same", [True, False])
def test_against_greedy(same):
    rng = random.Random(3)
    for _ in range(60):
        def some(k):
            return {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(k)}
        starts = some(8)
        inner = starts if same else some(8)
        machine = W.Automaton(sorted(starts), None if same else sorted(inner))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(100)]
        length = np.array([len(w) for w in words])
        got = machine.counts(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length, length)
        assert got.tolist() == [greedy(w, starts, inner) for w in words]


def test_documents(spark):
    pieces = W.pieces_of(public_tokenizers.path("word_bpe_49k.json"))
    pool = set(pieces)
    texts = [None, "", "Hello, World! don't", "éÉ 日本 x_y" + "z" * 5000, "...", "Same same", "Same same", "\x00\x01"]
    rows = [(i or None, t, 9) for i, t in enumerate(texts)]
    got = W.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int"), W.Automaton(pieces)).collect()
    want = []
    for i, t in enumerate(texts):
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[!-~]", folded)
        want.append((i or None, len(words), sum(greedy(w.encode(), pool, pool) for w in words)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert W.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), W.Automaton(pieces)).count() == 0
