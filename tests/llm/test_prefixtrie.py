"""The conversation trie against one built from the root, edge rows, and digests over many blocks."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenark.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        full[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = sorted(c for c in who if len(full[c]) == len(path))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids), len(leaves),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def rebuilt_trie(spark, rows):
    turns = prefixtrie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    return Counter(map(tuple, prefixtrie.trie(prefixtrie.rebuilt(turns)).collect()))


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 317, 10**12 + 3]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, ["user", "assistant"][turn % 2], rng.choice(["yes", "no é", "perhaps"])))
    rng.shuffle(rows)
    assert rebuilt_trie(spark, rows) == brute(rows)
    assert Counter(map(tuple, prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, rebuild=False)


def test_edge_rows(spark):
    rows = [
        (0, None, None, None), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 0, "user", "b"), (None, 1, "user", "lost"), (1, 3, "", "x"), (1, None, "user", ""),
        (2, 1, None, "x"), (305, 0, "user", "only one"), (306, 0, "user", "one"), (306, 1, "assistant", "long " * 50_000), (101, 0, "ab", "c"), (102, 0, "a", "bc"),
    ]
    assert rebuilt_trie(spark, rows) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(7, 0, "user", "hi", 1, "x")], SCHEMA + ", depth int, path string").withColumnRenamed("path", "pos")
    assert prefixtrie.conversation_trie(df).count() == 2


def test_ends_of_a_crowded_node_stream_in_blocks(spark):
    ids = [-5, *range(3000, 14_000), 10**10]
    rows = [(c, 0, "user", "the same first turn") for c in ids]
    got = prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 1").collect()
    assert len(got) == 1 and got[0].n_convs == len(ids) and got[0].saved_tokens == (len(ids) - 1) * 19
    assert got[0].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_one_grouping_a_level(spark):
    turns = prefixtrie.numbered_turns(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)).withColumn("part", F.lit(0))
    plan = prefixtrie.paths(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1  # numbering, running hashes and paths share one shuffle


def test_long_conversations_take_no_steps_of_their_own(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}" if t < 3 else f"turn {t} of {c % 2}") for c in (11, 12, 14) for t in range(60 + c % 5)] + [(13, 0, "user", "turn 0")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, prefixtrie.conversation_trie(df).collect())) == brute(rows, rebuild=False)
    turns = prefixtrie.numbered_turns(df.where("conv_id <> 14")).withColumn("part", F.lit(0))
    chains = prefixtrie.paths(prefixtrie.marked(turns, turns.select("conv_id").distinct()))
    _, entries = prefixtrie.tails(chains, prefixtrie.Scratch(spark, "test"))
    assert entries.agg(F.max("at")).first()[0] == 3
