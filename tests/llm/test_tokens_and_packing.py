"""Token files round-trip exactly; packing holds every piece once and fixes only dominating sets."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lumenark.llm import packing, tokenfile
from lumenark.llm.common import Scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "Hello, world", 0), (1, None, 1), (2, "", 2), (None, "no id", 3), (5, "again " * 9000, 4), (4, "twin", 5), (4, "twin", 6), (4, "other", 7)]


def docs(spark, rows=ROWS):
    # ``ids`` and ``part`` clash with the file's own names.
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids int, part int")


def test_token_file_round_trip(spark):
    path = Scratch(spark, "t").path("ids")
    tokenfile.write_tokens(docs(spark), path, WORDS, 1)
    plain = Tokenizer.from_file(WORDS)
    want = sorted((-1 if d is None else d, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, _ in ROWS)
    rows = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 4, 5]
    assert [r["start"] for r in rows] == list(itertools.accumulate([0] + [r["n_tokens"] for r in rows]))[:-1]
    for r in tokenfile.digests(spark, path).collect():
        ids = next(x["ids"] for x in rows if x["start"] == r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    one = tokenfile.read_tokens(spark, path, columns=["doc_id", "start"], where="doc_id = 3").collect()
    assert [tuple(r) for r in one] == [(3, next(r["start"] for r in rows if r["doc_id"] == 3))]


def test_file_layout(spark, tmp_path):
    path = str(tmp_path / "ids")
    many = [(i, f"some words {i % 7}", 0) for i in range(5000)]
    tokenfile.write_tokens(docs(spark, many).coalesce(1), path, WORDS, 1, options={"parquet.block.size": "20000", "parquet.page.row.count.limit": "100"})
    meta = pq.ParquetFile(next((tmp_path / "ids").glob("part-*"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["at"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_empty_tables(spark):
    path = Scratch(spark, "t").path("ids")
    tokenfile.write_tokens(docs(spark).limit(0), path, WORDS, 1)
    assert tokenfile.digests(spark, path).count() == 0
    assert packing.pack(docs(spark).limit(0), BYTES, 2).count() == 0


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack_holds_everything_gapless(spark, capacity):
    rng = random.Random(2)
    rows = ROWS + [(100 + i, "word " * rng.randrange(0, 30), 0) for i in range(300)]
    got = packing.pack(docs(spark, rows), BYTES, 2, capacity).collect()
    plain = Tokenizer.from_file(BYTES)
    want = Counter()
    for d, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[d, k, s, n, zlib.crc32(np.array(ids[s: s + n], dtype="<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity


def optimum(lengths, capacity):
    """Least number of bins, by trying each item in each bin."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[j] + lengths[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    fixed_some = 0
    for _ in range(400):
        lengths = sorted((rng.randrange(2, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        h = packing.Histogram(Counter(lengths), 20)
        fixed = packing.reduce_instance(h, 20)
        rest = [s for s in range(21) for _ in range(int(h.n[s]))]
        assert sum((Counter({s: k * m for s, k in Counter(f).items()}) for f, m in fixed), Counter(rest)) == Counter(lengths)
        fixed_some += bool(fixed)
        assert sum(m for _, m in fixed) + optimum(sorted(rest, reverse=True), 20) == optimum(lengths, 20)
    assert fixed_some > 200


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
