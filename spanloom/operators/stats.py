"""Statistics and introspection of stored regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.tiling import DEFAULT_BIN, explode_tiles


def dataset_stats(intervals: DataFrame) -> DataFrame:
    """(ds_idx, n_regions, avg_size, n_stored) over all parsed rows; n_stored counts those with start < end."""
    size = F.col("end") - F.col("start")
    return intervals.groupBy("ds_idx").agg(F.count("*").alias("n_regions"), F.avg(size).alias("avg_size"), F.count_if(size > 0).alias("n_stored"))


def global_stats(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count("*").alias("n_regions"), F.avg(F.col("end") - F.col("start")).alias("avg_size"))


def tiled(intervals: DataFrame, bin_size: int = DEFAULT_BIN) -> DataFrame:
    return explode_tiles(intervals.where(F.col("start") < F.col("end")), bin_size)


def tile_histogram(intervals: DataFrame, bin_size: int = DEFAULT_BIN) -> DataFrame:
    return tiled(intervals, bin_size).groupBy("contig", "tile").agg(F.count("*").alias("n"))


def tiles_per_contig(intervals: DataFrame, bin_size: int = DEFAULT_BIN) -> DataFrame:
    """(contig, n_tiles): last occupied tile + 1. No explode: the last tile follows from the greatest end."""
    valid = intervals.where(F.col("start") < F.col("end"))
    top = F.greatest(F.max("end") - 1, F.lit(0))
    return valid.groupBy("contig").agg((F.call_function("div", top, F.lit(bin_size)) + 1).alias("n_tiles"))


def replicated_total(intervals: DataFrame, bin_size: int = DEFAULT_BIN) -> DataFrame:
    """Records over all tiles, copies included, computed without making the copies."""
    from spanloom.functions.tiling import first_tile, last_tile

    valid = intervals.where(F.col("start") < F.col("end"))
    copies = last_tile(F.col("start"), F.col("end"), bin_size) - first_tile(F.col("start"), bin_size) + 1
    return valid.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n_records"))


def contig_dictionary(intervals: DataFrame) -> DataFrame:
    """(contig_id, contig): dense ids in name order."""
    names = intervals.where(F.col("start") < F.col("end")).select("contig").where(F.col("contig").isNotNull()).distinct()
    return names.select((F.row_number().over(W.orderBy("contig")) - 1).alias("contig_id"), "contig")


def contig_id(contigs: DataFrame, name: str) -> int:
    """The contig's id, -1 if there is none such."""
    row = contigs.where(F.col("contig") == name).select("contig_id").head()
    return -1 if row is None else row[0]


def bin_data(intervals: DataFrame, contig: str, tile: int, bin_size: int = DEFAULT_BIN) -> DataFrame:
    """(ds_idx, start, end) of one tile, 0-based, by start; copies of longer regions included. Only a filter, no explode."""
    from spanloom.functions.tiling import first_tile, last_tile

    s, e = F.col("start"), F.col("end")
    near = (s < (tile + 1) * bin_size) & ((e > tile * bin_size) if tile else F.lit(True)) & (s < e)
    inside = (first_tile(s, bin_size) <= tile) & (last_tile(s, e, bin_size) >= tile)
    return intervals.where((F.col("contig") == contig) & near & inside).select("ds_idx", "start", "end").orderBy("start", "end", "ds_idx")


def bin_len(intervals: DataFrame, contig: str, tile: int, bin_size: int = DEFAULT_BIN) -> DataFrame:
    return bin_data(intervals, contig, tile, bin_size).agg(F.count("*").alias("n"))


def prefix_max_end(intervals: DataFrame, bin_size: int = DEFAULT_BIN) -> DataFrame:
    """Running greatest end within each tile, by start: a bound for early stops in a tile scan."""
    w = W.partitionBy("contig", "tile").orderBy("start", "end", "r_id").rowsBetween(W.unboundedPreceding, 0)
    return tiled(intervals, bin_size).select("contig", "tile", "r_id", F.max("end").over(w).alias("max_end"))
