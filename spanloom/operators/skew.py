"""Per-key results where a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.strategy import leaf_tasks

NODE = "__node"

#: How partial states of each kind are merged.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": lambda c: F.hll_union_agg(c)}


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: dict[str, tuple[str, Column | None]], fan_in: int = 16, leaves: int | None = None) -> DataFrame:
    """Aggregate by ``keys`` through a tree, so that no task receives more than ``fan_in`` partials of a key.

    ``states`` names each result: ``("count", condition or None)``, ``("sum" | "min" | "max", column)`` or
    ``("distinct", column)`` (a mergeable sketch, finished as an estimate). Every input chunk - a task's partition, whose
    size the scan bounds - combines its rows locally into one state per key; then states meet in groups of ``fan_in``
    neighbouring chunks, and so on for log(leaves) rounds, one before the last at least. A key that fills every chunk hence costs its
    rows only where they lie, and each round only states. ``leaves`` is estimated from the input's size where it isn't given; a
    wrong one changes the rounds only.

    Nulls: a null key is a key of its own; sums, minima and maxima skip nulls and are null where nothing remains; counts
    are 0. An empty input gives no rows. The keys' names mustn't begin with two underscores; other columns don't matter.
    """
    if leaves is None:
        leaves = leaf_tasks(df)
    level = df.select(
        *keys,
        F.spark_partition_id().alias(NODE),
        *((F.lit(True) if c is None else c).alias(f"__{name}") for name, (_, c) in states.items()),
    )
    first = {
        "count": F.count_if,
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "distinct": lambda c: F.hll_sketch_agg(c),
    }
    aggregates = [first[kind](F.col(f"__{name}")).alias(name) for name, (kind, _) in states.items()]
    merges = [_MERGE[kind](name).alias(name) for name, (kind, _) in states.items()]
    while True:
        leaves = -(-leaves // fan_in)
        node = F.call_function("div", F.col(NODE), F.lit(fan_in)).cast("int").alias(NODE)
        level, aggregates = level.groupBy(*keys, node).agg(*aggregates), merges
        if leaves <= fan_in:
            break
    level = level.groupBy(*keys).agg(*merges)
    return level.select(*keys, *((F.hll_sketch_estimate(name) if kind == "distinct" else F.col(name)).alias(name) for name, (kind, _) in states.items()))


def region_totals(intervals: DataFrame, fan_in: int = 16) -> DataFrame:
    """(key_kind, key_text, n_rows, n_valid, width, min_start, max_end) of every contig ('name') and dataset ('nr').

    Both kinds come from one pass: each row goes into its contig's and its dataset's state. n_valid, width, min_start and
    max_end concern rows with 0 <= start < end.
    """
    s, e = F.col("start"), F.col("end")
    valid = F.coalesce((s >= 0) & (s < e), F.lit(False))
    kinds = F.array(
        F.struct(F.lit("name").alias("key_kind"), F.col("contig").alias("key_text")),
        F.struct(F.lit("nr").alias("key_kind"), F.col("ds_idx").cast("string").alias("key_text")),
    )
    rows = intervals.select(F.inline(kinds), *(F.when(valid, c).alias(n) for n, c in (("start", s), ("end", e))))
    states = {
        "n_rows": ("count", None),
        "n_valid": ("count", s.isNotNull()),
        "width": ("sum", e - s),
        "min_start": ("min", s),
        "max_end": ("max", e),
    }
    return tree_aggregate(rows, ["key_kind", "key_text"], states, fan_in, leaves=leaf_tasks(intervals))


def heavy_keys(intervals: DataFrame, share: float = 0.03, fan_in: int = 16) -> DataFrame:
    """(key_kind, key_text, n_rows) of the keys that hold at least ``share`` of all rows, null keys left out."""
    all_rows = intervals.agg(F.count("*")).scalar()
    totals = region_totals(intervals, fan_in)
    return totals.where(F.col("key_text").isNotNull() & (F.col("n_rows") >= F.lit(share) * all_rows)).select("key_kind", "key_text", "n_rows")
