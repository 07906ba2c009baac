"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match cuts a word into the longest piece that begins it, then the longest that begins
the rest, and so on. The automaton is a trie of the vocabulary with failure links: where a node has
no child for the next byte, its link leads to the node of what remains once the pieces that greedy
matching must cut by now are popped, and their number is stored with the link. So every byte is read
once, no piece is built, and a count is a sum of stored numbers. All distinct words of a batch walk
the automaton in step, one byte a round, as numpy arrays.

Words are runs of ASCII letters (A-Z folded), digits and non-ASCII characters, in UTF-8 bytes; every
other visible ASCII character is a word of its own. A word that greedy matching cannot cut whole is
one unknown token.

Defined results. NULL and empty texts have 0 words and 0 tokens. Repeated rows count alike, NULL ids
stay NULL. Other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm.common import FOLD, WORD_BYTE, arrow_map, table, text_bytes
from lumenark.llm.encode import _byte_letters
from lumenark.llm.shingles import word_hashes

NONE = -1


class Automaton:
    """``starts`` are the pieces that may begin a word, ``inner`` those that may follow (the same ones by default)."""

    def __init__(self, starts: list[bytes], inner: list[bytes] | None = None):
        child: list[dict[int, int]] = [{}]
        whole = [False]

        def add(root: int, piece: bytes) -> None:
            node = root
            for b in piece:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    whole.append(False)
                node = child[node][b]
            whole[node] = True

        self.inner = 0
        if inner is not None:
            self.inner = len(child)
            child.append({})
            whole.append(False)
            for piece in inner:
                add(self.inner, piece)
        for piece in starts:
            add(0, piece)
        link, pops = [NONE] * len(child), [0] * len(child)
        queue = [0] if inner is None else [0, self.inner]
        for node in queue:
            for b, to in child[node].items():
                queue.append(to)
                if whole[to]:
                    link[to], pops[to] = self.inner, 1
                    continue
                at, popped = link[node], pops[node]
                while at != NONE and b not in child[at]:
                    popped, at = popped + pops[at], link[at]
                if at != NONE:
                    link[to], pops[to] = child[at][b], popped
        self.link, self.pops = np.array(link, dtype=np.int32), np.array(pops, dtype=np.int32)
        #: Tokens still to pop where a word ends; NONE if what is left cannot be cut.
        finish = np.full(len(child), NONE, dtype=np.int32)
        finish[[0, self.inner]] = 0
        for node in queue:
            chain, at = [], node
            while finish[at] == NONE and link[at] != NONE and at not in (0, self.inner):
                chain.append(at)
                at = link[at]
            if finish[at] != NONE:
                for step in reversed(chain):
                    finish[step] = pops[step] + finish[link[step]]
        self.finish = finish
        edges = sorted((node << 8 | b, to) for node, kids in enumerate(child) for b, to in kids.items())
        self.edge = np.array([e for e, _ in edges] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.to = np.array([t for _, t in edges] + [NONE], dtype=np.int32)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 8 | symbol
        at = np.searchsorted(self.edge, key)
        return np.where(self.edge[at] == key, self.to[at], NONE)

    def counts(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of the words ``raw[start: start + length]``."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, count = np.zeros(len(start), dtype=np.int32), np.zeros(len(start), dtype=np.int64)
        known = np.ones(len(start), dtype=bool)
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))  # words longer than i
            todo = np.flatnonzero(known[:n])
            if not len(todo):
                break
            symbol = raw[start[todo] + i]
            while len(todo):
                to = self._step(state[todo], symbol)
                met = to != NONE
                state[todo[met]] = to[met]
                todo, symbol = todo[~met], symbol[~met]
                if len(todo):
                    back = self.link[state[todo]]
                    count[todo] += self.pops[state[todo]]
                    lost = back == NONE
                    known[todo[lost]] = False
                    todo, symbol = todo[~lost], symbol[~lost]
                    state[todo] = back[~lost]
        last = self.finish[state]
        out = np.empty(len(start), dtype=np.int64)
        out[order] = np.where(known & (last != NONE), count + last, 1)
        return out


def pieces_of(vocabulary: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes, word-end marks taken off; special tokens are left out."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    mark = spec["model"].get("end_of_word_suffix") or ""
    byte = {letter: b for b, letter in enumerate(_byte_letters())}
    plain = {t.removesuffix(mark) if mark else t for t in spec["model"]["vocab"] if t not in special}
    return sorted(bytes(byte[c] for c in t) for t in plain if t and all(c in byte for c in t))


def token_counts(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every text."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # a few megabytes: the vocabulary's size, not the corpus's
    single = np.zeros(256, dtype=bool)
    single[[b for b in range(33, 127) if not WORD_BYTE[b]]] = True

    def count(batch):
        machine = shared.value
        raw, offsets = text_bytes(batch.column("text"))
        folded = FOLD[raw]
        alone = np.concatenate([[0], np.cumsum(single[raw])])
        signs = alone[offsets[1:]] - alone[offsets[:-1]]
        one = np.zeros(256, dtype=np.int64)
        one[single] = machine.counts(np.flatnonzero(single).astype(np.uint8), np.arange(single.sum()), np.ones(int(single.sum()), dtype=np.int64))
        cost = np.concatenate([[0], np.cumsum(one[raw])])
        hashes, at = word_hashes(batch.column("text"))
        inside = np.concatenate([[False], WORD_BYTE[raw], [False]])
        fresh = np.zeros(len(raw) + 1, dtype=bool)
        fresh[offsets] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | fresh))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh))
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        pieces = machine.counts(folded, start[first], (end - start)[first])[which.ravel()] if len(first) else np.empty(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(pieces)])
        words = np.diff(at) + signs
        tokens = total[at[1:]] - total[at[:-1]] + cost[offsets[1:]] - cost[offsets[:-1]]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(tokens.astype(np.int64))], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, count, "doc_id bigint, n_words bigint, n_tokens bigint")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), Automaton(pieces_of(public_tokenizers.path("word_bpe_49k.json"))))
