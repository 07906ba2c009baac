"""JSON cells are read whole."""

from pyspark.sql import functions as F

from lumenark.functions import jsonx


def test_no_depth_is_dropped(spark):
    ten = '{"a": ["first", ' * 10 + '"deep"' + ', "last"]}' * 10
    cells = [ten, '{"a":{"b":{"c":{"d":{"e":"deep"}}}}}', '[{"label": "dog", "conf": "0.9"}, "", "cat"]', "plain", None]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, cell string").select("i", jsonx.flatten_json(F.col("cell")).alias("t")).collect()
    want = ", ".join(["first"] * 10 + ["deep"] + ["last"] * 10)
    assert [r["t"] for r in sorted(rows)] == [want, "deep", "dog, cat", "plain", None]
    assert jsonx._phrase([[["x"]] * 2]) == "x, x"
