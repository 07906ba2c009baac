"""Card filters come before the candidate cut."""

from lumenark.operators import search


def test_filtered_search_finds_what_ranks_low(spark):
    moments = spark.createDataFrame([(i, f"e{i}", "s", "red bicycle", 1.0 if i < 40 else 0.1, None) for i in range(50)],
                                    "id bigint, entity_key string, source string, text string, weight double, t_start double")
    cards = spark.createDataFrame([(f"e{i}", "many" if i < 40 else "rare", "c", [], 10.0) for i in range(50)],
                                  "entity_key string, creator string, category string, collections array<string>, duration double")
    found = search.hybrid(moments, cards, "red bicycle", candidates=5, filters=search.Filters(creator="rare"))
    assert [r["entity_key"] for r in found.hits.collect()] == [f"e{i}" for i in range(40, 45)]
    assert {r["value"] for r in found.facets.collect() if r["field"] == "creators"} == {"many"}
    assert {r["entity_key"] for r in search.hybrid(moments, cards, "red bicycle", candidates=5).hits.collect()} == {f"e{i}" for i in range(5)}
