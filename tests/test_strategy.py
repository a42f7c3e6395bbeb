"""Look-ups and size estimates."""

from pyspark.sql import functions as F

from spanloom.plans import strategy


def test_look_up(spark):
    """Broadcast or met under salts: the same rows, null keys and repeated rows included, the hot key spread."""
    rows = spark.range(0, 5000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 11).cast("int").alias("k"), (F.col("id") % 40).alias("x"))
    rows = rows.unionByName(rows.limit(20))
    table = spark.createDataFrame([(k, f"n{k}") for k in [*range(9), None]], "k int, name string")
    want = sorted((str(r.k), r.x, f"n{r.k}") for r in rows.collect() if r.k is None or r.k < 9)
    for limit in (100, 0):
        got = strategy.looked_up(rows, table, ["k"], limit)
        assert sorted((str(r.k), r.x, r.name) for r in got.collect()) == want
    assert strategy.exchanges(strategy.looked_up(rows.where("x < 100"), table, ["k"])) <= 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        salted = strategy.looked_up(rows, table, ["k"], 0).where("k = 7").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(salted) > 1 and max(r["count"] for r in salted) < 0.7 * sum(r["count"] for r in salted)


def test_leaf_tasks(spark):
    least = spark.sparkContext.defaultParallelism
    assert strategy.leaf_tasks(spark.range(10)) == least
    assert strategy.leaf_tasks(spark.range(1 << 40)) > 1000
    assert strategy.leaf_tasks(spark.createDataFrame([(1,)], "a int")) >= least
    assert strategy.leaf_tasks(spark.read.parquet("/root/testdata/sf0.001/intervals.parquet")) == least
