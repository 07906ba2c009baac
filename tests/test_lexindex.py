"""The stored inverted index against scoring by a scan, its pruning, batches, and the plans it is read with."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenark.operators import lexindex, search
from lumenark.operators.lexindex import LexicalIndex

WORDS = "the of bicycle bicycles red green 12 été ete naïve schön x's under_score über Über ß".split()


def passages(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if i % 50 == 7 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))), rng.choice([None, 0.01, 1.0, 2.5]), i % 9, rng.choice("ab")) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, text string, weight double, entity_key int, source string")


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    df = passages(spark)
    index = LexicalIndex(spark, str(tmp_path_factory.mktemp("index")))
    index.append(df.where("id < 120"), 0)
    index.append(df.where("id < 250"), 1)  # the first 120 are there
    index.append(df, 2)
    index.append(df, 2)
    return df, index


@pytest.mark.parametrize("terms, prefix, every", [(["red"], None, False), (["red", "bicycle"], None, True), (["the", "red", "12"], None, False), ([], "bic", False), (["green"], "ü", False), (["nowhere"], None, True)])
def test_scores_equal_a_scan(grown, terms, prefix, every):
    df, index = grown
    want = {r["id"]: r["score"] for r in search.bm25_scores(df, terms, prefix, every).collect()}
    got = {r["id"]: r["score"] for r in index.scores(terms, prefix, every).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    best = [(r["id"], r["rank"]) for r in index.best(terms, 7, prefix, every).orderBy("rank").collect()]
    assert best == [(r["id"], r["rank"]) for r in search.top_ranked(search.bm25_scores(df, terms, prefix, every), 7).orderBy("rank").collect()]


def test_search_and_like_equal_a_scan(grown):
    df, index = grown
    for query in ("red bicycle", "the red green 12 of", "nothing bicy", "", "a"):
        want = [(r["id"], r["rank"]) for r in search.lexical(df, query, 25).orderBy("rank").collect()]
        assert [(r["id"], r["rank"]) for r in index.search(query, 25).orderBy("rank").collect()] == want, query
    want = [r["id"] for r in search.like_fallback(df.where("weight IS NOT NULL"), "cycle", 500).orderBy("rank").collect()]
    got = [r["id"] for r in index.like("cycle", 500).orderBy("rank").collect()]
    assert [i for i in got if i in set(want)] == want


def test_within_narrows_rows_not_statistics(grown):
    df, index = grown
    within = (F.col("source") == "a") & (F.col("entity_key") < 4)
    want = {r["id"]: round(r["score"], 9) for r in search.bm25_scores(df, ["red", "the"], within=within).collect()}
    assert {r["id"]: round(r["score"], 9) for r in index.scores(["red", "the"], within=within).collect()} == want


def test_blocks_that_cannot_reach_the_page_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexindex, "BLOCK", 20)
    monkeypatch.setattr(lexindex, "SEEDS", 1)
    rows = [(i, "bicycle " * (30 if i < 5 else 1) + "word " * (i % 40), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, text string, weight double")
    index = LexicalIndex(spark, str(tmp_path))
    index.append(df, 0)
    bounds = {r["block"]: r["bound"] for r in index.bounds([("bicycle", False)]).collect()}
    scores = index.scores(["bicycle"]).collect()
    assert len(bounds) > 10 and max(r["score"] for r in scores) <= max(bounds.values()) + 1e-9
    got = [r["id"] for r in index.best(["bicycle"], 1).collect()]
    assert got == [max(scores, key=lambda r: (r["score"], -r["id"]))["id"]]
    top = max(r["score"] for r in scores)
    assert sum(b >= top - 1e-8 for b in bounds.values()) < len(bounds) / 2


def test_accents_fold_in_passages_and_queries(spark, tmp_path):
    df = spark.createDataFrame([(1, "Été NAÏVE"), (2, "ete naive"), (3, "hiver")], "id bigint, text string")
    index = LexicalIndex(spark, str(tmp_path), fold=True)
    index.append(df, 0)
    assert sorted(r["id"] for r in index.scores(["été"]).collect()) == [1, 2] == sorted(r["id"] for r in index.scores([], "nai").collect())


def test_empty_table(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path))
    index.append(passages(spark).limit(0), 0)
    assert index.search("red").count() == 0 and index.vocabulary().count() == 0 and index.like("red").count() == 0


def test_plans_prune(grown):
    _, index = grown
    plan = index.scores(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(bucket" in plan.replace("isnotnull(bucket#", "") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert not re.search(r"text#|passages", plan)
    plan = index.vocabulary("bi")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), StringStartsWith(term,bi)]" in plan


def test_hybrid_counts_every_match(grown, spark):
    df, index = grown
    cards = df.select("entity_key").distinct().withColumn("creator", (F.col("entity_key") % 2).cast("string"))
    want = {r["entity_key"]: r["n"] for r in search.bm25_scores(df, ["red"]).groupBy("entity_key").agg(F.count("*").alias("n")).collect()}
    got = search.hybrid(df.withColumn("t_start", F.col("id")), cards, "red", candidates=5, index=index)
    assert {r["entity_key"]: r["hit_count"] for r in got.matched.collect()} == want
    assert sum(r["n"] for r in got.facets.collect()) == len(want)
    most = max(want.values())
    kept = search.hybrid(df.withColumn("t_start", F.col("id")), cards, "red", candidates=5, index=index, filters=search.Filters(min_hits=most)).hits.collect()
    assert kept and all(want[r["entity_key"]] == r["hit_count"] == most for r in kept)


def test_postings_are_counted_in_the_row_and_shuffled_once(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "b a b", 1.0), (1, "a b b", 1.0), (2, "", 1.0), (None, "c", None)], "id bigint, text string, weight double")
    rows = rows.select("id", F.split("text", " ").alias("tokens"), "weight", F.lit(None).cast("string").alias("entity_key"), F.lit(None).cast("string").alias("source")) \
        .withColumn("tokens", F.filter("tokens", lambda t: t != "")).withColumn("dl", F.size("tokens"))
    for repeated in (False, True):  # the second text of passage 1 adds to the postings of the first
        out = index._grouped(rows, 0, 1, repeated)
        assert len(re.findall(r"Exchange ", out._jdf.queryExecution().executedPlan().toString())) == 1
        got = {r["term"]: (r["n"], r["cf"], sorted((p["id"] or 0, p["tf"]) for p in r["posts"])) for r in out.collect()}
        both = {True: {"a": (1, 2, [(1, 2)]), "b": (1, 4, [(1, 4)])}, False: {"a": (2, 2, [(1, 1), (1, 1)]), "b": (2, 4, [(1, 2), (1, 2)])}}
        assert got == both[repeated] | {"c": (1, 1, [(0, 1)])}


def test_a_passage_that_comes_twice_is_one_posting(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path))
    index.append(spark.createDataFrame([(1, "red fox"), (1, "red fox"), (2, "red")], "id bigint, text string"), 0)
    assert {(r["term"], r["df"], r["cf"]) for r in index.read("terms").collect()} == {("red", 2, 3), ("fox", 1, 2)}
