"""Tree aggregation against a plain aggregate."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import skew


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (5, 2), (16, 2), (16, 4), (40, 3)])
def test_rounds(spark, parts, fan_in):
    df = spark.range(0, 3000, numPartitions=parts).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE cast(id % 40 AS string) END k", "CASE WHEN id % 7 = 0 THEN NULL ELSE id END v", "id % 11 n", "0 n_rows"
    )
    v = F.col("v")
    states = {"rows": ("count", None), "some": ("count", v > 100), "total": ("sum", v), "least": ("min", v), "most": ("max", v), "kinds": ("distinct", F.col("n"))}
    got = {r.k: tuple(r)[1:] for r in skew.tree_aggregate(df, ["k"], states, fan_in).collect()}
    plain = df.groupBy("k").agg(F.count("*"), F.count_if(v > 100), F.sum("v"), F.min("v"), F.max("v"), F.countDistinct("n"))
    assert got == {r.k: tuple(r)[1:] for r in plain.collect()}


def test_empty_and_null(spark):
    schema = "contig string, ds_idx int, start long, end long, key_kind string"
    assert skew.region_totals(spark.createDataFrame([], schema)).count() == 0
    assert skew.heavy_keys(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("a", 1, None, 5, "x"), (None, None, 3, 9, "x"), ("a", 1, 9, 3, "x"), ("a", 1, 2, 3, "x")], schema)
    got = {tuple(r) for r in skew.region_totals(df).collect()}
    assert got == {("name", "a", 3, 1, 1, 2, 3), ("nr", "1", 3, 1, 1, 2, 3), ("name", None, 1, 1, 6, 3, 9), ("nr", None, 1, 1, 6, 3, 9)}
    assert {tuple(r) for r in skew.heavy_keys(df, 0.5).collect()} == {("name", "a", 3), ("nr", "1", 3)}
