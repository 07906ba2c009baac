"""Ingest and identity fed by arrivals: each reads its own rows only, and ends where one run over everything ends."""

from pyspark.sql import functions as F

from lumenark.operators import identity
from lumenark.streaming import pipelines


def arrive(df, folder, n):
    df.coalesce(1).write.parquet(f"{folder}/in/arrival={n}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_ingest_reads_no_batch_again(spark, tmp_path):
    folder, schema = str(tmp_path), "id bigint, x string"
    seen = []
    for n in range(4):
        rows = [(i, f"{n}") for i in range(n * 50, n * 50 + 100)] + [(None, "none")]  # half of each arrival is new
        arrive(spark.createDataFrame(rows, schema), folder, n)
        seen += pipelines.ingest_once(stream(spark, folder, schema), f"{folder}/out", ["id"], f"{folder}/cp")
    assert [p["numInputRows"] for p in seen] == [101] * 4  # rows read do not grow with the batch
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == 251 and got.select("id").distinct().count() == 251
    assert {r["x"]: r["n"] for r in got.where("id IS NOT NULL").groupBy("x").agg(F.count("*").alias("n")).collect()} == {"0": 100, "1": 50, "2": 50, "3": 50}
    again = pipelines.ingest_once(stream(spark, folder, schema), f"{folder}/out", ["id"], f"{folder}/cp")
    assert again == [] and spark.read.parquet(f"{folder}/out").count() == 251


def test_identity_of_arrivals_is_that_of_the_whole(spark, tmp_path):
    folder, schema = str(tmp_path), "alias string, entity_key string, kind string, prio int"
    rows = [
        ("cust_01", "cust_01", "self", 0), ("tg7", "cust_01", "message", 2), ("tg7", "cust_02", "message", 1), ("cust_02", "cust_02", "self", 0),
        ("cust_02", "cust_01", "message", 1), ("old", "cust_09", "message", 1), ("old", "cust_01", "ledger", 3), ("", "cust_01", "message", 1), ("tg8", "cust_03", "message", 2)]
    whole = spark.createDataFrame(rows, schema)
    keys = whole.where("kind = 'self'").select("entity_key")
    for order in (rows, rows[::-1]):
        place = f"{folder}/{order[0][0]}"
        total = 0
        for n in range(3):
            part = order[n * 3: n * 3 + 3]
            arrive(spark.createDataFrame(part, schema), place, n)
            total += sum(p["numInputRows"] for p in pipelines.learn_stream(stream(spark, place, schema), f"{place}/out", f"{place}/cp"))
        assert total == len(rows)
        got = identity.learned(spark.read.parquet(f"{place}/out"))
        want = identity.learn(whole, keys)
        for a, b in zip(got, want):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
