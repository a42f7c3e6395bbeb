"""Continuous periods and gaps of overlapping intervals, per entity.

Starts and ends are sorted independently. With starts s1 <= s2 <= ... and ends e1 <= e2 <= ..., a gap lies between e_i and
s_(i+1) exactly where s_(i+1) > e_i; the start after one gap and the end before the next bound a period.

Entities of up to ``hot_rows`` rows are moved once, by entity, and ranked where they lie. Larger ones are never gathered
in one task: their boundaries are first collapsed by position, then ranked within coordinate blocks whose rank offsets
come from the blocks' counts, and start i+1 meets end i by a shuffle on the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.tiling import div
from spanloom.plans.strategy import small_side
from spanloom.shared import written

HOT_ROWS = 1_000_000
BLOCK = 1 << 20
BLOCKS = 1 << 16


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of all keys, as grouping has it."""
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return met


def _keyed(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    s, e = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    return df.where((s >= 0) & (s < e)).select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), s.alias("__s"), e.alias("__e"))


def _hot(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Entities above ``hot_rows`` with the width of their coordinate blocks: few, since each holds that many rows."""
    span = F.max("__e") - F.min("__s")
    found = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__s").alias("__lo"), span.alias("__span")).where(F.col("__n") > hot_rows)
    return found.withColumn("__width", F.greatest(F.lit(BLOCK), div(F.col("__span"), BLOCKS) + 1)).select(*keys, "__lo", "__width", "__n")


def _cold_meetings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __rank, __next, __last): the start of rank i+1 and the end of rank i, for each rank i >= 0."""
    placed = rows.repartition(*keys)
    ranked = placed.withColumn("__rs", F.row_number().over(W.partitionBy(*keys).orderBy("__s"))).withColumn("__re", F.row_number().over(W.partitionBy(*keys).orderBy("__e")))
    two = F.array(
        F.struct((F.col("__rs") - 1).alias("__rank"), F.col("__s").alias("__next"), F.lit(None).cast("long").alias("__last")),
        F.struct(F.col("__re").alias("__rank"), F.lit(None).cast("long").alias("__next"), F.col("__e").alias("__last")),
    )
    return ranked.select(*keys, F.inline(two)).groupBy(*keys, "__rank").agg(F.max("__next").alias("__next"), F.max("__last").alias("__last"))


def _hot_meetings(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`_cold_meetings`, for the hot entities' collapsed boundaries, with ranks as running counts."""
    inside = rows.alias("r").join(hot.drop("__n").alias("h"), _same(keys, "r", "h")).select(*(F.col(f"r.{k}").alias(k) for k in keys), "__s", "__e", "__lo", "__width")
    two = F.array(F.struct(F.lit(0).alias("__side"), F.col("__s").alias("__pos")), F.struct(F.lit(1).alias("__side"), F.col("__e").alias("__pos")))
    marks = inside.select(*keys, "__lo", "__width", F.inline(two)).withColumn("__block", div(F.col("__pos") - F.col("__lo"), F.col("__width")))
    runs = marks.groupBy(*keys, "__side", "__block", "__pos").agg(F.count("*").alias("__n"))
    blocks = runs.groupBy(*keys, "__side", "__block").agg(F.sum("__n").alias("__n"))
    before = W.partitionBy(*keys, "__side").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "__side", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    joined = runs.alias("r").join(offsets.alias("o"), _same([*keys, "__side", "__block"], "r", "o")).select("r.*", "__offset")
    so_far = W.partitionBy(*keys, "__side", "__block").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    upto = joined.withColumn("__upto", F.col("__offset") + F.sum("__n").over(so_far))
    start = F.col("__side") == 0
    # A run of equal starts counts by its first rank, one of equal ends by its last: only these can bound a gap.
    rank = F.when(start, F.col("__upto") - F.col("__n")).otherwise(F.col("__upto"))
    return (
        upto.select(*keys, rank.alias("__rank"), F.when(start, F.col("__pos")).alias("__next"), F.when(~start, F.col("__pos")).alias("__last"))
        .groupBy(*keys, "__rank")
        .agg(F.max("__next").alias("__next"), F.max("__last").alias("__last"))
    )


def _bounds(df: DataFrame, keys: Sequence[str], start: str, end: str, hot_rows: int) -> tuple[list[DataFrame], list[str], DataFrame, DataFrame]:
    k = [f"__k{i}" for i in range(len(keys))]
    rows = _keyed(df, keys, start, end)
    # Written once and counted, so that rows needn't move to be told hot from cold.
    hot = small_side(written(_hot(rows, k, hot_rows), "hot"))
    cold = rows.alias("r").join(hot.alias("h"), _same(k, "r", "h"), "left_anti")
    return [_cold_meetings(cold, k), _hot_meetings(rows, hot, k)], k, rows, hot


def gaps(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, gap_start, gap_end): stretches between an entity's first start and last end that none of its intervals covers.

    Only rows with 0 <= start < end count; rows with a null in either are left out. A null key is a key of its own.
    Touching and repeated intervals leave no gap; an entity of one interval has none; an empty table gives no rows.
    Names of other columns don't matter.
    """
    parts, k, _, _ = _bounds(df, keys, start, end, hot_rows)
    out = [p.where(F.col("__next") > F.col("__last")) for p in parts]
    named = [F.col(a).alias(b) for a, b in zip(k, keys, strict=True)]
    return out[0].unionByName(out[1]).select(*named, F.col("__last").alias("gap_start"), F.col("__next").alias("gap_end"))


def periods(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, period_start, period_end): maximal stretches that an entity's intervals cover without a gap.

    Touching intervals form one period. Rows, nulls and empty tables as in :func:`gaps`.
    """
    parts, k, _, hot = _bounds(df, keys, start, end, hot_rows)
    named = [F.col(a).alias(b) for a, b in zip(k, keys, strict=True)]
    # A period starts at each start that exceeds the end ranked before it (the first has none), and reaches to the end
    # before the next gap (the last has none).
    edge = (F.col("__next") > F.col("__last")) | (F.col("__rank") == 0) | F.col("__next").isNull()
    w = W.partitionBy(*k).orderBy("__rank")
    cold = parts[0].where(edge).withColumn("__to", F.lead("__last").over(w)).where(F.col("__next").isNotNull())
    cold = cold.select(*k, F.col("__next").alias("__from"), "__to")
    edges = parts[1].where(edge).alias("r").join(hot.alias("h"), _same(k, "r", "h")).where(F.col("__next").isNotNull() | (F.col("__rank") == F.col("__n")))
    edges = edges.select("r.*", "__lo", "__width")
    edges = edges.withColumn("__block", div(F.coalesce("__last", "__next") - F.col("__lo"), F.col("__width")))
    here = W.partitionBy(*k, "__block").orderBy("__rank")
    heads = edges.groupBy(*k, "__block").agg(F.min_by("__last", "__rank").alias("__head"))
    heads = heads.select(*k, "__block", F.lead("__head").over(W.partitionBy(*k).orderBy("__block")).alias("__after"))
    led = edges.withColumn("__lead", F.lead("__last").over(here)).alias("r").join(heads.alias("h"), _same([*k, "__block"], "r", "h"))
    warm = led.where(F.col("__next").isNotNull()).select(*(F.col(f"r.{c}").alias(c) for c in k), F.col("__next").alias("__from"), F.coalesce("__lead", "__after").alias("__to"))
    return cold.unionByName(warm).select(*named, F.col("__from").alias("period_start"), F.col("__to").alias("period_end"))
