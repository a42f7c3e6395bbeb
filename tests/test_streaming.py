"""A stream of queries against a static store."""

from spanloom.operators import overlap
from spanloom.streaming.overlap import stream_counts, stream_pairs

SF = "/root/testdata/sf0.01"


def test_stream_equals_batch(spark, tmp_path):
    r = overlap.stored(spark.read.parquet(f"{SF}/intervals.parquet"))
    q = spark.read.parquet(f"{SF}/queries.parquet")
    q.repartition(3).write.parquet(f"{tmp_path}/q")
    stream = lambda: spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    run = stream_counts(stream(), r).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(x) for x in spark.table("counts").collect()} == {tuple(x) for x in overlap.count_hits(q, r).collect()}
    run = stream_pairs(stream(), r).writeStream.outputMode("append").format("memory").queryName("met").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("met").count() == overlap.pairs(q, r).count()
