"""A store of regions: Parquet tables, range-clustered by contig and start.

Clustering by range instead of one folder per contig keeps both ends healthy: a contig that holds a third of all rows is
spread over many files, and hundreds of small contigs share one. Row groups carry the bounds of contig and start, so a
region search reads only what it needs, and so does a set of queries: it is covered by a bounded number of ranges, which are filters
of the scan.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tiling import DEFAULT_BIN
from spanloom.operators import matching, matrix, overlap, stats
from spanloom.shared import release, written
from spanloom.sources import sinks, tilefile


class IntervalStore:
    def __init__(self, spark: SparkSession, path: str, bin_size: int, has_value: bool):
        self.spark, self.path, self.bin_size, self.has_value = spark, path, bin_size, has_value

    @classmethod
    def create(cls, spark: SparkSession, path: str, regions: DataFrame, datasets: DataFrame, bin_size: int = DEFAULT_BIN) -> IntervalStore:
        """Write the store; refuses to overwrite. ``regions`` as the readers give them, ``datasets`` (ds_idx, file)."""
        if bin_size < 1:
            raise ValueError("the tile width must be positive")
        has_value = "value" in regions.columns
        # Parsed once: the statistics, the range bounds and the clustered write each read the compact table.
        regions = written(regions, "parsed")
        counted = stats.dataset_stats(regions)
        info = datasets.select("ds_idx", "file").join(counted, "ds_idx", "left").select("ds_idx", "file", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), "avg_size", F.coalesce("n_stored", F.lit(0)).alias("n_stored"))
        valid = regions.where(F.col("start") < F.col("end"))
        columns = ["contig", "start", "end", *(["value"] if has_value else []), "ds_idx"]
        clustered = valid.select(*columns).repartitionByRange("contig", "start").sortWithinPartitions("contig", "start")
        clustered.withColumn("r_id", F.monotonically_increasing_id()).write.mode("errorifexists").parquet(f"{path}/intervals")
        kept = spark.read.parquet(f"{path}/intervals")
        names = stats.contig_dictionary(kept).join(stats.tiles_per_contig(kept, bin_size), "contig").select("contig_id", "contig", "n_tiles")
        info.write.mode("errorifexists").parquet(f"{path}/datasets")
        names.write.mode("errorifexists").parquet(f"{path}/contigs")
        spark.createDataFrame([(bin_size, has_value)], "bin_size int, has_value boolean").coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")
        release(regions)
        return cls(spark, path, bin_size, has_value)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IntervalStore:
        """The store at ``path``: a folder that :meth:`create` wrote, or a file of the binary layout beside its index table."""
        if os.path.isfile(path.removeprefix("file://")):
            return TileStore(spark, path)
        meta = spark.read.parquet(f"{path}/meta").head()
        return cls(spark, path, meta.bin_size, meta.has_value)

    def save_file(self, path: str) -> TileStore:
        """Write the store as one file of the binary layout and its index table; refuses to overwrite."""
        path = path.removeprefix("file://")
        tilefile.write(self.intervals, path, self.bin_size)
        with open(TileStore.index_of(path), "x") as f:
            f.writelines(line + "\n" for line in sinks.index_lines(self.datasets))
        return TileStore(self.spark, path)

    @property
    def intervals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/intervals")

    @property
    def datasets(self) -> DataFrame:
        """(ds_idx, file, n_regions, avg_size, n_stored); n_regions and avg_size include rows that aren't stored."""
        return self.spark.read.parquet(f"{self.path}/datasets")

    @property
    def contigs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/contigs")

    @property
    def n_contigs(self) -> int:
        return self.contigs.count()

    @property
    def n_datasets(self) -> int:
        return self.datasets.count()

    @property
    def dataset_ids(self) -> list[int | None]:
        """The datasets' ids in order, which may leave numbers out; a null is the last."""
        return [r.ds_idx for r in self.datasets.select("ds_idx").orderBy(F.asc_nulls_last("ds_idx")).toLocalIterator()]

    def contig_id(self, name: str) -> int:
        return stats.contig_id(self.contigs, name)

    def inside(self, ranges: list[tuple[str, int, int]]) -> DataFrame:
        """The stored regions that meet one of the ranges; the ranges reach the scan."""
        return self.intervals.where(overlap.within(ranges))

    def near(self, queries: DataFrame) -> DataFrame:
        """The stored regions that ``queries`` may meet. Queries are counted first; a stream's can't be, and read all."""
        ranges = None if queries.isStreaming else overlap.covering_ranges(queries)
        return self.intervals if ranges is None else self.inside(ranges)

    def pairs(self, queries: DataFrame, min_value: int = 0, compat_empty_first_tile: bool = False) -> DataFrame:
        # Whether a query's first tile is empty shows in regions that it doesn't meet.
        stored = self.intervals if compat_empty_first_tile else self.near(queries)
        if min_value > 0 and not self.has_value:
            raise ValueError("a score threshold needs a store with values")
        return overlap.pairs(queries, stored, bin_size=self.bin_size, min_value=min_value, compat_empty_first_tile=compat_empty_first_tile)

    def full_hits(self, queries: DataFrame) -> DataFrame:
        return self.pairs(queries).join(self.datasets.select("ds_idx", "file"), "ds_idx", "left")

    def count_hits(self, queries: DataFrame, min_value: int = 0, compat_empty_first_tile: bool = False) -> DataFrame:
        """(ds_idx, file, n_regions, n_hits) of all datasets."""
        return self._counted(self.pairs(queries, min_value, compat_empty_first_tile))

    def _counted(self, hits: DataFrame) -> DataFrame:
        n = hits.groupBy("ds_idx").agg(F.count("*").alias("n_hits"))
        return self.datasets.join(n, "ds_idx", "left").select("ds_idx", "file", "n_regions", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))

    def hit_vector(self, queries: DataFrame, into: np.ndarray | None = None, min_value: int = 0) -> np.ndarray:
        """Hits as a vector with a place for every dataset, in the order of :attr:`dataset_ids`, added to ``into`` if given; its sum
        is the number of hits. Hits of regions whose dataset isn't in the catalogue have no place."""
        ids = self.dataset_ids
        out = np.zeros(len(ids), np.int64) if into is None else into
        hits = self.pairs(queries, min_value).where("ds_idx IS NOT NULL").groupBy("ds_idx").agg(F.count("*").alias("n"))
        n = {r.ds_idx: r.n for r in hits.toLocalIterator()}
        out += np.array([n.get(x, 0) for x in ids], np.int64)
        return out

    def search(self, contig: str, start: int, end: int, min_value: int = 0) -> DataFrame:
        """(ds_idx, file, n_regions, n_hits) of one region, all datasets."""
        return self._counted(overlap.wanted(self.region(contig, start, end), min_value if self.has_value else 0))

    def region(self, contig: str, start: int, end: int) -> DataFrame:
        return overlap.region(self.intervals, contig, start, end)

    def matrix(self, value_above: int = 0) -> DataFrame:
        if value_above > 0 and not self.has_value:
            raise ValueError("a score threshold needs a store with values")
        return matrix.hit_matrix(self.intervals, value_above=value_above)

    def similarity(self, queries: DataFrame) -> DataFrame:
        """(ds_idx, file, n_regions, similarity) of all datasets."""
        kept = queries.where((F.col("start") >= 0) & (F.col("start") <= F.col("end")))
        sums = matching.match_sums(kept, self.near(kept), bin_size=self.bin_size)
        s, n_q = F.coalesce("sm_sum", F.lit(0.0)), kept.count()
        rate = s / F.nullif(F.lit(n_q) + F.col("n_regions") - s, F.lit(0.0))
        return self.datasets.join(sums, "ds_idx", "left").select("ds_idx", "file", "n_regions", F.coalesce(rate, F.lit(0.0)).alias("similarity"))

    def _named(self, contig_number: int) -> str | None:
        row = self.contigs.where(F.col("contig_id") == contig_number - 1).head()
        return None if row is None else row.contig

    def bin_len(self, contig_number: int, bin_number: int) -> int | None:
        """Records of a tile, both numbers from 1; None out of range."""
        data = self.bin_data(contig_number, bin_number)
        return None if data is None else data.count()

    def bin_data(self, contig_number: int, bin_number: int) -> DataFrame | None:
        name = self._named(contig_number)
        if name is None or bin_number < 1 or bin_number > self.contigs.where(F.col("contig") == name).head().n_tiles:
            return None
        # Tile 0 holds what begins before it as well.
        low = (bin_number - 1) * self.bin_size if bin_number > 1 else -(1 << 62)
        return stats.bin_data(self.inside([(name, low, bin_number * self.bin_size)]), name, bin_number - 1, self.bin_size)

    def tile_histogram(self) -> DataFrame:
        return stats.tile_histogram(self.intervals, self.bin_size)


class TileStore(IntervalStore):
    """A store in one file of the binary layout, with the table of its datasets in ``<name>_index.tsv``.

    The file is opened by every task, so it must lie where all executors see it. Searches read only the tiles of their ranges.
    """

    def __init__(self, spark: SparkSession, path: str):
        tilefile.register(spark)
        path = path.removeprefix("file://")
        self.header = tilefile.header(path)
        super().__init__(spark, path, self.header["bin_size"], self.header["has_value"])

    @staticmethod
    def index_of(path: str) -> str:
        return os.path.splitext(path)[0] + "_index.tsv"

    def _read(self, **options: str) -> DataFrame:
        df = self.spark.read.format("tilefile").options(**options).load(self.path)
        return df if self.has_value else df.drop("value")

    @property
    def intervals(self) -> DataFrame:
        return self._read().drop("tile")

    @property
    def datasets(self) -> DataFrame:
        table = sinks.read_index_tsv(self.spark, "file://" + self.index_of(self.path))
        return table.select("ds_idx", "file", "n_regions", "avg_size")

    @property
    def contigs(self) -> DataFrame:
        rows = [(i, c, int(n)) for i, (c, n) in enumerate(zip(self.header["contigs"], self.header["tiles"], strict=True))]
        return self.spark.createDataFrame(rows, "contig_id int, contig string, n_tiles long")

    def inside(self, ranges: list[tuple[str, int, int]]) -> DataFrame:
        return self._read(ranges=json.dumps(ranges)).drop("tile").where(overlap.within(ranges))

    def region(self, contig: str, start: int, end: int) -> DataFrame:
        return overlap.region(self.inside([(contig, start, max(start, end))]), contig, start, end)


__all__ = ["IntervalStore", "TileStore"]
