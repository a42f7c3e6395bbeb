"""Overlap counts of every dataset with every dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.tiling import DEFAULT_BIN, explode_tiles


def fitting_bin(intervals: DataFrame, least: int = 256, most: int = DEFAULT_BIN) -> int:
    """A power of two near the mean width: dense tables need narrower tiles than sparse ones. One small aggregate."""
    mean = intervals.where(F.col("start") < F.col("end")).agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1.0
    return max(least, min(most, 1 << max(0, int(mean) - 1).bit_length()))


def hit_matrix(intervals: DataFrame, bin_size: int | None = None, value_above: int = 0) -> DataFrame:
    """(ds_a, ds_b, n): ordered pairs of overlapping regions, a region with itself included; symmetric.

    ``value_above`` > 0 keeps regions with a greater value on both sides. Without ``bin_size`` the tile width follows
    the mean width. Each unordered pair of datasets' tiles is met once in each direction by one self join; the pairs are
    counted within the join's stage, so only partial counts are shuffled.
    """
    r = intervals.where((F.col("start") < F.col("end")) & F.col("contig").isNotNull())
    if value_above > 0:
        r = r.where(F.col("value") > value_above)
    return met(explode_tiles(r.select("contig", "start", "end", "ds_idx"), bin_size or fitting_bin(r), first="first"))


def met(tiled: DataFrame, half: bool = False) -> DataFrame:
    """The matrix of regions that :func:`explode_tiles` has placed, with their first tile; with ``half`` only its cells with ds_a up
    to ds_b, which say all of it where no dataset is null."""
    a = tiled.select("contig", "tile", *(F.col(c).alias(f"a_{c}") for c in ("start", "end", "first", "ds_idx")))
    b = tiled.select("contig", "tile", *(F.col(c).alias(f"b_{c}") for c in ("start", "end", "first", "ds_idx")))
    pair = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.col("tile") == F.greatest("a_first", "b_first"))
    if half:
        pair = pair & (F.col("a_ds_idx") <= F.col("b_ds_idx"))
    # Exploded sides outgrow any estimate of their size, so neither is broadcast; sorted runs spill, hash tables wouldn't.
    return a.join(b.hint("merge"), ["contig", "tile"]).where(pair).groupBy(F.col("a_ds_idx").alias("ds_a"), F.col("b_ds_idx").alias("ds_b")).agg(F.count("*").alias("n"))


def dense(matrix: DataFrame, datasets: list[int]) -> DataFrame:
    """The matrix with a column ``d<ds>`` for each of the given datasets and a row for each that has hits."""
    wide = matrix.groupBy("ds_a").pivot("ds_b", datasets).agg(F.sum("n"))
    return wide.select("ds_a", *(F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias(f"d{d}") for d in datasets))
