"""A page holds what the caller asks for."""

from pyspark.sql import functions as F

from lumenark.operators import ledger


def test_page_has_no_inner_cap(spark):
    items = spark.range(700).select(F.col("id").alias("key"), F.col("id").alias("position"), F.lit("queued").alias("state"))
    assert ledger.queue_page(items, limit=600).count() == 600
