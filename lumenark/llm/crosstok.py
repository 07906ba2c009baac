"""Alignment of two tokenizations of one text by galloping intersection of their token ends.

A token ends at a byte offset. The shorter list of ends drives: each of its ends gallops through
the longer one, in doubling steps from where its share of the text lets it be expected, then by
binary search inside the last step. The rank it gets and whether it met its equal say everything
else: common ends cut the tokens into groups, and the ranks of a token's two ends, counted in the
other list, are the range of tokens that it overlaps. All texts of a batch advance in step.

How many documents hold an overlapping pair of ids is counted corpus-wide without a row for each
pair and document. A batch of documents (a *chunk*) lists its distinct pairs once, with the number
of its documents that hold each; these lists are summed, the counts go back to the chunks that
asked, and a chunk's documents find theirs by position. A pair that stands in every document costs
a row a chunk.

Defined results. NULL and empty texts have no tokens, nor have texts that a vocabulary does not
give back byte for byte (their pieces joined differ from a space and the text); they have no group
and no link. Repeated rows count as documents each. An empty table gives no rows. Other columns are
not read, whatever their names. Special tokens' strings inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm.common import WORKER, Scratch, arrow_map, release, small_batches, table, text_bytes
from lumenark.llm.encode import Chunks, Encoder, _Cache, _byte_letters, _Irregular

STATE = "aligner"
#: Documents and bytes of text of a chunk.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
#: Bytes of text of a chunk that are aligned at once: a byte takes some hundred bytes of arrays meanwhile.
STEP_BYTES = 1 << 19
#: Row groups of 32 MB: two writers share an executor with two workers.
LINKED_OPTIONS = {"compression": "zstd", "parquet.block.size": str(32 << 20)}


def gallop(values: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each value the first index in ``ends[low:high]``, ascending, that is not below it; ``high`` if all are.

    Steps double from ``guess`` to either side until they enclose the place, which binary search then finds.
    """
    a, b = low - 1, high.copy()  # ends[a] < value <= ends[b], where these indices exist
    live = np.flatnonzero(low < high)
    at, step = np.clip(guess[live], low[live], high[live] - 1), 1
    up = ends[at] < values[live]
    while len(live):
        below = ends[at] < values[live]
        a[live[below]] = at[below]
        b[live[~below]] = at[~below]
        on = below == up  # has not passed its value yet
        live, at, up = live[on], at[on], up[on]
        at = np.where(up, at + step, at - step)
        inside = (at > a[live]) & (at < b[live]) & (at >= low[live]) & (at < high[live])
        live, at, up, step = live[inside], at[inside], up[inside], step * 2
    live = np.flatnonzero(b - a > 1)
    while len(live):
        middle = (a[live] + b[live]) // 2
        below = ends[middle] < values[live]
        a[live[below]] = middle[below]
        b[live[~below]] = middle[~below]
        live = live[b[live] - a[live] > 1]
    return b


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def intersect(a_ends: np.ndarray, a_at: np.ndarray, b_ends: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, common) of every A token of many texts: B ends below its own in its text, and whether one equals it.

    ``a_at`` and ``b_at`` are the offsets of the texts in the concatenated lists.
    """
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    rank, common = np.zeros(len(a_ends), dtype=np.int64), np.zeros(len(a_ends), dtype=bool)
    for a_drives in (True, False):
        texts = np.flatnonzero((n_a <= n_b) == a_drives)
        short_n, short_at, long_n, long_at = (n_a, a_at, n_b, b_at) if a_drives else (n_b, b_at, n_a, a_at)
        short, long = (a_ends, b_ends) if a_drives else (b_ends, a_ends)
        count = short_n[texts]
        text = np.repeat(texts, count)
        if not len(text):
            continue
        k = _ramp(count)
        low, high = long_at[text], long_at[text] + long_n[text]
        values = short[short_at[text] + k]
        found = gallop(values, low, high, low + k * long_n[text] // short_n[text], long)
        met = found < high
        met[met] = long[found[met]] == values[met]
        if a_drives:
            rank[a_at[text] + k], common[a_at[text] + k] = found - low, met
        else:
            # B end j lies below A end i exactly if at most i A ends are no greater than it.
            reach = found + met
            counted = np.bincount(reach[reach < high], minlength=len(a_ends))
            own = np.repeat(texts, n_a[texts])
            i = a_at[own] + _ramp(n_a[texts])
            running = np.cumsum(counted)
            before = np.where(a_at[own] > 0, running[a_at[own] - 1], 0)
            rank[i] = running[i] - before
            common[found[met]] = True
    return rank, common


class Pieces:
    """Ids and bytes of a sentencepiece model; a space stands before every text."""

    def __init__(self, path: str, room: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # If no piece goes on after a space, what follows a single space is encoded for itself.
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self.chunks = _Cache(self._alone, room)

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), dtype="<u4").tobytes() if text else b""

    def _alone(self, chunk: str) -> bytes:
        if not self.apart or not chunk or "▁" in chunk:
            raise _Irregular
        return self._whole(chunk)

    def encode(self, text: str) -> bytes:
        try:
            return b"".join(map(self.chunks.__getitem__, text.split(" ")))
        except _Irregular:
            return self._whole(text)

    def encode_column(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        return chunks.encode(self.chunks.__getitem__, self._whole)


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary for a space and the text."""

    def __init__(self, path: str, room: int = 200_000):
        self.encoder = Encoder(path, room)
        self.encoder.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes = [b""] * self.encoder.tokenizer.get_vocab_size()
        for entry, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.encoder.wide.__getitem__, re.split(r"(?<=\S)(?= \S)", " " + text))) if text else b""

    def encode(self, text: str) -> bytes:
        try:
            return b"".join(map(self.encoder.inner.__getitem__, text.split(" ")))
        except _Irregular:
            return self._whole(text)

    def encode_column(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        return chunks.encode(self.encoder.inner.__getitem__, self._whole)


class _Table:
    """Bytes of all ids as one array, for gathering."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.repeat(self.at[ids], size) + _ramp(size)]


class Aligned:
    """Tokens of a batch of texts: ids and offsets of both sides, and of every A token the range of B tokens it overlaps."""

    def __init__(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        self.a, self.a_at, self.b, self.b_at = a, a_at, b, b_at
        rank, self.common = intersect(a_ends, a_at, b_ends, b_at)
        self.last = np.repeat(b_at[:-1], np.diff(a_at)) + rank
        before = np.concatenate([[0], (self.last + self.common)[:-1]]) if len(a) else self.last
        heads = a_at[:-1][np.diff(a_at) > 0]
        before[heads] = b_at[:-1][np.diff(a_at) > 0]
        self.first = before
        self.text = np.repeat(np.arange(len(a_at) - 1), np.diff(a_at))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, pair) of every overlapping occurrence; a pair is ``a_id << 32 | b_id``."""
        n = self.last - self.first + 1
        i = np.repeat(np.arange(len(n)), n)
        return self.text[i], self.a[i].astype(np.int64) << 32 | self.b[self.first[i] + _ramp(n)]

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        n_a, n_b = len(self.a), len(self.b)
        ids, separator = np.empty(n_a + n_b, dtype=np.int64), np.full(n_a + n_b, ord(","), dtype=np.uint8)
        cut = np.flatnonzero(self.common)
        ends_a, ends_b = cut + 1, self.last[cut] + 1
        size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        starts_b = ends_b - size_b
        ids[np.arange(n_a) + np.repeat(starts_b, size_a)] = self.a
        ids[np.arange(n_b) + np.repeat(ends_a, size_b)] = self.b
        separator[ends_a + starts_b - 1] = ord("|")
        separator[ends_a + ends_b - 1] = ord(";")
        digits = np.full((n_a + n_b, 8), 0, dtype=np.uint8)
        digits[:, 7] = separator
        left = ids
        for k in range(6, -1, -1):
            digits[:, k] = np.where((left > 0) | (k == 6), left % 10 + 48, 0)
            left = left // 10
        shown = digits != 0
        flat = digits[shown].tobytes()
        at = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])[self.a_at + self.b_at].tolist()
        return [flat[x: max(x, y - 1)] for x, y in zip(at[:-1], at[1:])]


class Aligner:
    """Two vocabularies: a byte-level one (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = [ByteLevel(a_path), Pieces(b_path)]
        self.tables = [_Table(s.bytes) for s in self.sides]

    def align(self, column) -> Aligned:
        """Of an Arrow string column."""
        chunks = Chunks(column)
        raw, offsets = text_bytes(column)
        sizes = np.diff(offsets)
        sizes = np.where(sizes > 0, sizes + 1, 0)  # with the space
        whole = np.full(int(sizes.sum()), ord(" "), dtype=np.uint8)
        inner = np.ones(len(whole), dtype=bool)
        starts = np.cumsum(sizes) - sizes
        inner[starts[sizes > 0]] = False
        whole[inner] = raw
        good = sizes > 0
        found = []
        for side, known in zip(self.sides, self.tables):
            ids, at = side.encode_column(chunks)
            total = np.concatenate([[0], np.cumsum(known.size[ids])])[at]
            same = np.diff(total) == sizes
            token_ok, byte_ok = np.repeat(same, np.diff(at)), np.repeat(same, sizes)
            differs = known.joined(ids[token_ok]) != whole[byte_ok]
            owner = np.repeat(np.arange(len(sizes)), np.where(same, sizes, 0))
            same[owner[differs]] = False
            good &= same
            found.append((ids, at))
        out = []
        for (ids, at), known in zip(found, self.tables):
            n = np.diff(at)
            ids = ids[np.repeat(good, n)]
            at = np.concatenate([[0], np.cumsum(np.where(good, n, 0))])
            out += [ids, at]
            out.append(np.cumsum(known.size[ids]))
        a, a_at, a_ends, b, b_at, b_ends = out
        return Aligned(a, a_at, b, b_at, a_ends, b_ends)


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker: the one of the vocabularies asked for last."""
    kept = WORKER.get(STATE)
    if kept is None or kept[0] != (a_path, b_path):
        WORKER[STATE] = kept = ((a_path, b_path), Aligner(a_path, b_path))
    return kept[1]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: both id lists, and for every A token the first and the last B token that it overlaps.

    A group ends with an A token whose last B token is not the first one of the token after it; ``cuts`` lists
    the A tokens read up to each such end, and ``b_cuts`` the B tokens.
    """
    import pyarrow as pa

    def lists(values, at):
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))

    def show(batch):
        x = aligner(a_path, b_path).align(batch.column("text"))
        base = np.repeat(x.b_at[:-1], np.diff(x.a_at))
        cut = np.flatnonzero(x.common)
        at = np.concatenate([[0], np.cumsum(x.common)])[x.a_at]
        cols = [lists(x.a, x.a_at), lists(x.b, x.b_at), lists(x.first - base, x.a_at), lists(x.last - base, x.a_at),
                lists(cut + 1 - x.a_at[x.text[cut]], at), lists(x.last[cut] + 1 - base[cut], at)]
        names = ["doc_id", "a_ids", "b_ids", "first_b", "last_b", "cuts", "b_cuts"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    schema = "doc_id bigint, " + ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "first_b", "last_b", "cuts", "b_cuts"))
    return arrow_map(_rows(docs, id_col, text_col), show, schema, rows=CHUNK_ROWS, size=CHUNK_BYTES, keeps=STATE)


LINKED_SCHEMA = ("chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                 "at binary, times binary, pairs array<bigint>, held array<int>")


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every document's alignment, its distinct pairs by position in its chunk's list, and that list once a chunk."""
    import pyarrow as pa

    def link(batch):
        n = batch.num_rows
        sizes, groups, lists, owners, codes, counts = [], [], [], [], [], []
        rows = known = 0
        for step in small_batches([batch], CHUNK_ROWS, STEP_BYTES):
            x = aligner(a_path, b_path).align(step.column("text"))
            text, pair = x.links()
            sizes.append([np.diff(x.a_at), np.diff(x.b_at), np.bincount(x.text[x.common], minlength=step.num_rows), np.bincount(text, minlength=step.num_rows)])
            groups += [hashlib.sha256(g).hexdigest() if g else "" for g in x.group_texts()]
            distinct, code = np.unique(pair, return_inverse=True)
            keys, times = np.unique(text * max(len(distinct), 1) + code.ravel(), return_counts=True)
            owner, code = np.divmod(keys, max(len(distinct), 1))
            lists.append(distinct)
            owners.append(owner + rows)
            codes.append(code + known)
            counts.append(times.astype("<u4"))
            rows, known = rows + step.num_rows, known + len(distinct)
        pairs, place = np.unique(np.concatenate(lists), return_inverse=True)
        code = place.ravel()[np.concatenate(codes)]
        at = np.searchsorted(np.concatenate(owners), np.arange(n + 1)).tolist()
        raw, raw_times = code.astype("<u4").tobytes(), np.concatenate(counts).tobytes()
        slices = [[r[4 * i: 4 * j] for i, j in zip(at[:-1], at[1:])] for r in (raw, raw_times)]
        mine = uuid.uuid4().int >> 65
        first = lambda values: [values] + [None] * (n - 1)
        cols = [
            pa.array([mine] * n, type=pa.int64()), batch.column("doc_id"), *[pa.array(np.concatenate(c)) for c in zip(*sizes)], pa.array(groups),
            pa.array(slices[0], type=pa.binary()), pa.array(slices[1], type=pa.binary()),
            pa.array(first(pairs), type=pa.list_(pa.int64())), pa.array(first(np.bincount(code, minlength=len(pairs))), type=pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINKED_SCHEMA.split(", ")])

    return arrow_map(_rows(docs, id_col, text_col), link, LINKED_SCHEMA, rows=CHUNK_ROWS, size=CHUNK_BYTES, keeps=STATE)


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents that hold each pair linked, and whether no pair of its A id stands in more."""
    counts = lists.groupBy("pair").agg(F.sum("held").alias("n_docs"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: sizes of both sides, groups, links, links by their pair's corpus-wide count, digest of the groups."""
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession, "cross-tokenizer")
    table_ = scratch.keep(linked(docs, a_path, b_path, id_col, text_col), "linked", **LINKED_OPTIONS)
    lists = table_.where("pairs IS NOT NULL").select(F.col("chunk").alias("asker"), F.posexplode(F.arrays_zip("pairs", "held")).alias("i", "x")) \
        .select("asker", "i", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = scratch.keep(pair_counts(lists), "counts")
    replies = lists.join(counts, "pair").select("asker", "i", "n_docs", "best")
    digests = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def sums(texts, answers):
        """``answers`` has as many rows as the chunk has pairs."""
        release(None)
        order = np.argsort(answers.column("i").to_numpy())
        n_docs, best = answers.column("n_docs").to_numpy()[order], answers.column("best").to_numpy()[order]
        raw = [texts.column(c).to_pylist() for c in ("at", "times")]
        code, times = (np.frombuffer(b"".join(r), dtype="<u4").astype(np.int64) for r in raw)
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw[0]])]).astype(np.int64)
        total = [np.diff(np.concatenate([[0], np.cumsum(v)]).astype(np.int64)[ends]) for v in (times * best[code], times * n_docs[code])]
        cols = [texts.column(c) for c in digests]
        return pa.table([*cols[:5], pa.array(total[0]), pa.array(total[1]), cols[5]], names=[c.split()[0] for c in schema.split(", ")])

    asked = table_.select("chunk", *digests, "at", "times").groupBy("chunk")
    return asked.cogroup(replies.groupBy("asker")).applyInArrow(sums, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_statistics(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
