"""Every span stays with its verdict; copies of a text do not clear a live value."""

from lumenark.llm import secrets


def test_verdicts(spark, tmp_path):
    live, example, hot = ("ghp_" + w * 8 for w in ("Z9y8", "A1b2", "C3d4"))
    rows = [(0, f"key {live}", "one"), (1, f"key {live}", None), (2, f"see {example} here", "one"), (3, f"or {example}", "two")]
    rows += [(10 + i, f"{i} {hot}", "one") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = secrets.judged(docs).join(docs.select("doc_id", *secrets.row_key("doc_id", "text")), ["k1", "k2"]).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_owners"], r["n_texts"], r["live"]) for r in found if r["doc_id"] < 11} == {
        0: (2, 1, True), 1: (2, 1, True), 2: (2, 2, False), 3: (2, 2, False), 10: (1, 30, False)}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    listed = {r["doc_id"]: (r["spans"], r["n_live"]) for r in secrets.op7(spark, str(tmp_path)).collect()}
    assert listed[0] == listed[1] == ("prefixed:4:40", 1) and listed[2] == ("prefixed:4:40", 0) and listed[3] == ("prefixed:3:39", 0)
