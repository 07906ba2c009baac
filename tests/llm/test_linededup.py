"""Line deduplication against a plain reading of the rule, edge rows and hot keys."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lumenark.llm import linededup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """(doc_id, kept text) of every row; a NULL id comes last."""
    rank = {d: (d is None, d or 0) for d, _ in rows}
    key = lambda line: line.strip("\x20\t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, text in rows:
        kept = [x for x in (text or "").split("\n") if len(key(x)) < least or min(holders[key(x)], key=rank.get) == d]
        out.append((d, "\n".join(kept)))
    return Counter(out)


def ours(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return Counter((r.doc_id, r.text or "") for r in linededup.deduplicate(df).collect())


EDGES = [
    (3, "A shared line of words\nown of three"), (1, "  a SHARED line of words\t\nÀ shared line of words"), (None, "a shared line of words\nalone here, no id"),
    (None, "alone here, no id"), (5, None), (6, ""), (7, "\n\n\n"), (8, "short\nshort"), (9, "short"), (1, "a shared line of words"), (4, "\x0ba shared line of words\x0c\r"),
    (2, "twice in here only\ntwice in here only\n"), (10, "\xa0a shared line of words"), (11, "ÄÖÜ words of a line"), (12, "äöü words of a line"), (13, "ÄÖÜ words of a LINE"),
    (20, "own start\na shared line of words\na shared line of words\nown end of it\na shared line of words"), (20, "own start\na shared line of words\na shared line of words\nown end of it\na shared line of words"),
]


def test_edges(spark):
    assert ours(spark, EDGES) == brute(EDGES)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["ab", "Cd", "ef é", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(rng.choice([*range(40), None]), "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    assert ours(spark, rows) == brute(rows)


def test_hot_key_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_ROWS", 20)
    rows = [(i, f"the line that every document has\nline number {i} of its own\nline number {i % 50} of its own") for i in range(400)]
    rows.append((400, "\n".join(f"line number {i} of its own" if i % 3 else f"new line {i} of the long one" for i in range(20_000))))
    assert ours(spark, rows) == brute(rows)


def test_bitmap_codes_runs(spark):
    rows = [(1, "first common line\nsecond common line\nthird common line"), (2, "keep this line here\nfirst common line\nsecond common line\nand keep this\nthird common line\nlast")]
    got = linededup.bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.n_dropped, r.keep) for r in got] == [(2, 3, [1, 2, 1, 1])]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert linededup.deduplicate(empty).count() == 0
    rows = [(1, "a line of many words", 7, "x"), (2, "a line of many words\nand more", 8, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __doc int, keep string").withColumnRenamed("keep", "__keep")
    got = sorted(map(tuple, linededup.deduplicate(df).collect()))
    assert got == [(1, "a line of many words", 7, "x"), (2, "and more", 8, "y")]


def test_one_shuffle_streams_the_keys(spark):
    lines = spark.createDataFrame([(1, 2, 0, 5, 6)], "doc_id bigint, th bigint, pos int, h1 bigint, h2 bigint")
    hot = spark.createDataFrame([], "h1 bigint, h2 bigint, keeper struct<none boolean, doc_id bigint>")
    plan = linededup.later_lines(lines, hot)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange rangepartitioning", plan)) == 1 and "hashpartitioning" not in plan
