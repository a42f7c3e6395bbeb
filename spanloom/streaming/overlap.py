"""Overlaps of a stream of query regions with a static store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.tiling import DEFAULT_BIN
from spanloom.operators import overlap


def stream_pairs(queries: DataFrame, intervals: DataFrame, bin_size: int = DEFAULT_BIN, min_value: int = 0) -> DataFrame:
    """All pairs of streamed queries with stored regions: a stateless stream-static join, append mode."""
    return overlap.pairs(queries, intervals, bin_size=bin_size, min_value=min_value)


def stream_counts(queries: DataFrame, intervals: DataFrame, bin_size: int = DEFAULT_BIN, min_value: int = 0) -> DataFrame:
    """Running hits per dataset; the state is one number a dataset. Update or complete mode."""
    return stream_pairs(queries, intervals, bin_size, min_value).groupBy("ds_idx").agg(F.count("*").alias("n_hits"))
