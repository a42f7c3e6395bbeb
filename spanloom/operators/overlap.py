"""Interval-overlap joins and their counts.

The inequality join becomes an equality join on ``(contig, tile)``. A pair that shares several tiles is kept in one only:
the later of the two first tiles, in which both surely occur. So no DISTINCT is needed and repeated rows count each.
Rows with a null contig, start or end never match. Column names of the inputs beyond those used don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tiling import DEFAULT_BIN, div, explode_tiles, first_tile, overlaps
from spanloom.plans.strategy import BROADCAST_ROWS, small_side
from spanloom.schema import QUERIES


#: Ranges that a query set is covered by at most, the cells that they are merged from, and the cells' width.
RANGES, CELLS, CELL = 64, 4096, 1 << 22


def stored(intervals: DataFrame) -> DataFrame:
    """Regions that a store keeps: those with start < end. A null value counts as 0."""
    return intervals.where(F.col("start") < F.col("end")).withColumn("value", F.coalesce("value", F.lit(0)))


def _side(df: DataFrame, names: dict[str, str], bin_size: int, first: str) -> DataFrame:
    renamed = df.select("contig", *(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    start, end = names["start"], names["end"]
    return explode_tiles(renamed.where(F.col("contig").isNotNull()), bin_size, start, end, "tile", first)


def wanted(df: DataFrame, min_value: int) -> DataFrame:
    if min_value <= 0:
        return df
    if "value" not in df.columns:
        raise ValueError("a score threshold needs a store with values")
    return df.where(F.col("value") >= min_value)


def covering_ranges(queries: DataFrame, ranges: int = RANGES) -> list[tuple[str, int, int]] | None:
    """At most ``ranges`` stretches (contig, lo, hi), none overlapping another, outside of which no query has a hit: every region
    that a query meets has start < hi and end > lo of one of them. None where the queries lie in more contigs than that.

    Queries are first brought together by cell or, where these are too many, by contig, so no more than CELLS rows are collected;
    then the nearest neighbours are merged.
    """
    placed = queries.where(F.col("contig").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    found = None
    for key in ([div(F.col("start"), CELL)], []):
        found = placed.groupBy("contig", *(k.alias("cell") for k in key)).agg(F.min("start").alias("lo"), F.max("end").alias("hi")).limit(CELLS + 1).collect()
        if len(found) <= CELLS:
            break
    merged: list[list] = []
    for c, lo, hi in sorted((r.contig, r.lo, r.hi) for r in found):
        if merged and merged[-1][0] == c and lo <= merged[-1][2]:
            merged[-1][2] = max(hi, merged[-1][2])
        else:
            merged.append([c, lo, max(hi, lo)])
    if len(found) > CELLS or len({c for c, _, _ in merged}) > ranges:
        return None
    gaps = sorted((b[1] - a[2], i) for i, (a, b) in enumerate(zip(merged, merged[1:])) if a[0] == b[0])  # noqa: B905
    closed = {i for _, i in gaps[: max(0, len(merged) - ranges)]}
    out: list[list] = []
    for i, r in enumerate(merged):
        if i - 1 in closed:
            out[-1][2] = r[2]
        else:
            out.append(r)
    return [(c, lo, hi) for c, lo, hi in out]


def within(ranges: list[tuple[str, int, int]]) -> Column:
    """The condition that a region lies in one of the ranges; false for none."""
    met = F.lit(False)
    for contig in dict.fromkeys(c for c, _, _ in ranges):
        some = F.lit(False)
        for _, lo, hi in (r for r in ranges if r[0] == contig):
            some = some | ((F.col("start") < hi) & (F.col("end") > lo))
        met = met | ((F.col("contig") == contig) & some)
    return met


def pairs(queries: DataFrame, intervals: DataFrame, bin_size: int = DEFAULT_BIN, min_value: int = 0, compat_empty_first_tile: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All (query, region) pairs that overlap: q_id, q_start, q_end, contig, r_id, r_start, r_end, value, ds_idx.

    ``min_value`` > 0 keeps regions with at least that value. ``compat_empty_first_tile`` leaves out queries whose first
    tile holds no region at all (an old engine's behaviour); it isn't applied together with a threshold.
    Queries of at most ``broadcast_rows`` tiles, counted first, are broadcast, and the regions stay where they are; more
    are met in a sort-merge join by tile. Either input may be empty: so is the result.
    """
    r = wanted(intervals, min_value)
    extra = {c: c for c in ("value", "r_id", "ds_idx") if c in r.columns}
    left = _side(queries, {"q_id": "q_id", "start": "q_start", "end": "q_end"}, bin_size, "q_first")
    right = _side(r.where(F.col("start") < F.col("end")), {"start": "r_start", "end": "r_end", **extra}, bin_size, "r_first")
    if compat_empty_first_tile and min_value <= 0:
        occupied = right.select("contig", F.col("tile").alias("q_first")).distinct()
        left = left.join(occupied, ["contig", "q_first"], "left_semi")
    # Exploded sides outgrow any estimate of their size, so none is broadcast by estimate.
    found = small_side(left, broadcast_rows).join(right.hint("merge"), ["contig", "tile"]).where(
        overlaps(F.col("q_start"), F.col("q_end"), F.col("r_start"), F.col("r_end")) & (F.col("tile") == F.greatest("q_first", "r_first"))
    )
    return found.select("q_id", "contig", "q_start", "q_end", "r_start", "r_end", *extra)


def count_hits(queries: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """(ds_idx, n_hits): hits per dataset, those without hits left out."""
    return pairs(queries, intervals, **options).groupBy("ds_idx").agg(F.count("*").alias("n_hits"))


def count_hits_dense(queries: DataFrame, intervals: DataFrame, datasets: DataFrame, **options) -> DataFrame:
    """(ds_idx, file, n_hits) with a row for every dataset, 0 included."""
    hits = count_hits(queries, intervals, **options)
    return datasets.select("ds_idx", "file").join(hits, "ds_idx", "left").select("ds_idx", "file", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def count_hits_per_query(queries: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """(q_id, n_hits) of the queries that hit."""
    return pairs(queries, intervals, **options).groupBy("q_id").agg(F.count("*").alias("n_hits"))


def full_hits(queries: DataFrame, intervals: DataFrame, datasets: DataFrame, **options) -> DataFrame:
    """Every hit with its file name."""
    return pairs(queries, intervals, **options).join(datasets.select("ds_idx", "file"), "ds_idx", "left")


def region(intervals: DataFrame, contig: str, start: int, end: int, min_value: int = 0) -> DataFrame:
    """Regions that overlap one literal region: a plain filter, which reaches the Parquet scan."""
    r = wanted(intervals, min_value)
    return r.where((F.col("contig") == contig) & (F.col("start") < F.col("end")) & (F.col("start") < end) & (F.col("end") > start))


def region_counts(intervals: DataFrame, datasets: DataFrame, contig: str, start: int, end: int, min_value: int = 0) -> DataFrame:
    """(ds_idx, file, n_hits) of one region, datasets without hits included."""
    hits = region(intervals, contig, start, end, min_value).groupBy("ds_idx").agg(F.count("*").alias("n_hits"))
    return datasets.select("ds_idx", "file").join(hits, "ds_idx", "left").select("ds_idx", "file", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def literal_queries(spark: SparkSession, regions: Iterable[tuple[str, int, int]], n: int | None = None) -> DataFrame:
    """A query table of the caller's regions, the first ``n`` of them if given."""
    rows = [(i, c, s, e) for i, (c, s, e) in enumerate(list(regions)[:n])]
    return spark.createDataFrame(rows, QUERIES)


def pair_similarity(queries: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """Pairs with ``sm``, their Jaccard similarity in single precision."""
    found = pairs(queries, intervals, **options)
    both = F.least("q_end", "r_end") - F.greatest("q_start", "r_start")
    either = (F.col("q_end") - F.col("q_start")) + (F.col("r_end") - F.col("r_start")) - both
    return found.withColumn("sm", (both.cast("float") / either.cast("float")).cast("float"))


__all__ = ["count_hits", "count_hits_dense", "count_hits_per_query", "first_tile", "full_hits", "literal_queries", "pair_similarity", "covering_ranges", "pairs", "region", "region_counts", "stored", "within"]
