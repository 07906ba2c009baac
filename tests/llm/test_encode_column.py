"""Columns of texts: the library's own ids, each distinct chunk asked for once, memory by the step and not by the batch."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenark.llm import crosstok
from lumenark.llm.encode import Chunks, Encoder
from test_encode import PIECES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_column_equals_the_library(name):
    path = public_tokenizers.path(name)
    plain, enc, rng = Tokenizer.from_file(path), Encoder(path, room=64), random.Random(7)
    texts = [rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12))) for _ in range(2000)]
    texts += [None, "", " ", "\n", "one", "a b\nc", " \n", "x\n y", "x" * 5000, "two  spaces", "a\nb " * 30]
    for column in (pa.array(texts), pa.array(["skipped", *texts], type=pa.large_string()).slice(1), pa.array([None, ""], type=pa.string())):
        ids, at = enc.encode_column(column, (1).to_bytes(4, "little"))
        got = [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in column.to_pylist()]


def test_distinct_chunks_are_asked_for_once():
    asked = []

    def ids(chunk):
        asked.append(chunk)
        return len(chunk).to_bytes(4, "little")

    got, at = Chunks(pa.array(["a bb a", None, "bb bb ccc"])).encode(ids, lambda text: b"")
    assert sorted(asked) == ["", "a", "bb", "ccc"] and got.tolist() == [1, 2, 1, 0, 2, 2, 3] and at.tolist() == [0, 3, 4, 7]


def test_long_chunks_are_not_kept():
    enc = Encoder(A, room=64)
    for i in range(50):
        enc.encode(f"{'word' * 50}{i}")
        enc.encode_column(pa.array([f"some {'word' * 50}{i}"]))
    assert max(map(len, [*enc.first, *enc.inner, *enc.words, *enc.wide])) <= 64


def test_memory_of_a_chunk_of_documents(monkeypatch):
    got = {}
    monkeypatch.setattr(crosstok, "_rows", lambda *a: None)
    monkeypatch.setattr(crosstok, "arrow_map", lambda df, fn, *a, **k: got.update(fn=fn))
    crosstok.linked(None, A, B)
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinsrhl") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got["fn"](batch.slice(0, 1))  # loads the vocabularies
    tracemalloc.start()
    try:
        out = got["fn"](batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == len(texts) and peak < 35 * batch.nbytes, peak / batch.nbytes
