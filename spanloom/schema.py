"""Schemas of the tables that the engine stores and exchanges."""

from pyspark.sql import types as T

INTERVALS = T.StructType(
    [
        T.StructField("r_id", T.LongType()),
        T.StructField("contig", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("value", T.IntegerType()),
        T.StructField("ds_idx", T.IntegerType()),
    ]
)

DATASETS = T.StructType(
    [
        T.StructField("ds_idx", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("n_regions", T.LongType()),
        T.StructField("avg_size", T.DoubleType()),
    ]
)

CONTIGS = T.StructType(
    [
        T.StructField("contig_id", T.IntegerType()),
        T.StructField("contig", T.StringType()),
        T.StructField("n_tiles", T.LongType()),
    ]
)

META = T.StructType([T.StructField("bin_size", T.IntegerType()), T.StructField("has_value", T.BooleanType())])

QUERIES = T.StructType(
    [
        T.StructField("q_id", T.LongType()),
        T.StructField("contig", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)
