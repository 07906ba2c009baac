"""Cross-tokenizer alignment against comparing every token with every other, and the libraries' own ids."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from lumenark.llm import crosstok

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "hello world", " leading", "trailing ", "two  spaces   three", "line\nbreak\n\n twice", "tab\tbed", "été naïve Übung", "日本語のテキスト 漢字", "🙂🙃 emoji 👩‍👩‍👧",
    "<|endoftext|> and <s> </s> <0x41> as text", "▁ a low line ▁▁", "don't can't we'll", "\x00 null", "x" * 3000, "mixed ё Ж ß ﬁ ligature", " no break", "é combining", "1234567890 " * 40, "\r\n windows\r\n",
]


def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def sides(text, t, sp):
    """(ids, bytes of each) of both tokenizations; empty where the bytes do not give the text back."""
    if not text:
        return [], []
    letters = crosstok._byte_letters()
    a = [(i, bytes(letters.index(c) for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute(rows):
    t, sp = libraries()
    found, holders = [], defaultdict(set)
    for n, (doc, text) in enumerate(rows):
        spans = []
        for side in sides(text, t, sp):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(y[0]) for y in b if lo < y[2] <= hi) for lo, hi in zip([0, *cuts], cuts)]
        for pair in set(links):
            holders[pair].add(n)
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    count = {p: len(v) for p, v in holders.items()}
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return Counter((d, na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if na else "") for d, na, nb, ng, links, g in found)


def ours(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return Counter(map(tuple, crosstok.link_statistics(df, A, B).collect()))


def documents(n):
    return [(i, x[:400] if x else x) for i, x in duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' LIMIT {n}").fetchall()]


def test_edges_and_repeated_rows(spark):
    rows = [*enumerate(TEXTS), (3, "hello world"), (3, "hello world"), (None, "hello there")]
    assert ours(spark, rows) == brute(rows)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(crosstok, "CHUNK_ROWS", 7)
    rows = documents(60)
    assert ours(spark, rows) == brute(rows)


def test_ids_equal_the_libraries():
    t, sp = libraries()
    a, b = crosstok.ByteLevel(A), crosstok.Pieces(B)
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "é", "ß", "日", "🙂", " ", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "<|endoftext|>", "<s>", "1", "▁", "Z", "\x00"]
    texts = [x for x in TEXTS if x] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(4000)] + [x for _, x in documents(100) if x]
    for text in texts:
        assert np.frombuffer(a.encode(text), "<u4").tolist() == t.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert np.frombuffer(b.encode(text), "<u4").tolist() == sp.encode(text), repr(text)


def test_galloping_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n_a, n_b = rng.integers(0, 9, 6), rng.integers(0, 40, 6)
        if rng.random() < 0.5:
            n_a, n_b = n_b, n_a
        a = [np.sort(rng.choice(60, n, replace=False)) for n in n_a]
        b = [np.sort(rng.choice(60, n, replace=False)) for n in n_b]
        at = [np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b)]
        rank, common = crosstok.intersect(np.concatenate(a), at[0], np.concatenate(b), at[1])
        assert rank.tolist() == [int((y < v).sum()) for x, y in zip(a, b) for v in x]
        assert common.tolist() == [bool((y == v).any()) for x, y in zip(a, b) for v in x]


def test_alignments_show_the_ranges(spark):
    df = spark.createDataFrame([(1, "hello wonderful worlds"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in crosstok.alignments(df, A, B).collect()}
    r = got[1]
    assert len(r.first_b) == len(r.last_b) == len(r.a_ids) and r.cuts[-1] == len(r.a_ids) and r.b_cuts[-1] == len(r.b_ids) == r.last_b[-1] + 1
    assert all(f <= x for f, x in zip(r.first_b, r.last_b)) and got[2].a_ids == [] and got[2].cuts == []


def test_empty_table_clashing_names_and_a_long_text(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert crosstok.link_statistics(empty, A, B).count() == 0
    long = "words of a long text é " * 40_000
    df = spark.createDataFrame([(1, long, 5, "p")], "doc_id bigint, text string, chunk int, pairs string")
    got = crosstok.link_statistics(df, A, B).first()
    t, sp = libraries()
    assert (got.n_a, got.n_b) == (len(t.encode(" " + long).ids), len(sp.encode(long))) and got.count_sum == got.n_links == got.n_best or got.n_best <= got.n_links


def test_a_table_of_one_batch_of_texts_without_tokens():
    x = crosstok.Aligner(A, B).align(pa.array([None, "", "▁"], type=pa.string()))
    assert len(x.a) == len(x.b) == 0 and x.group_texts() == [b"", b"", b""]
