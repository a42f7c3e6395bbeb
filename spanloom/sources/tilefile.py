"""A single-file binary layout of tiles, as a Spark data source, for exchange with other tools.

Little-endian: tile width, record type, number of contigs (int32 each); tiles per contig (int32); records per tile, contig by
contig (int32); contig names (40 bytes each, zero-padded); then the tiles' records, each tile sorted by start. A record is
(dataset, start, end) and, in type 1, value, all int32. A region is stored in every tile that it touches.

Tasks read and write their own parts of the file, so it must lie where all executors see it.
"""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.functions.tiling import DEFAULT_BIN, explode_tiles
from spanloom.shared import release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the bytes of a contig's name, of which the last must be zero.
NAME_BYTES = 40
#: Bytes of records that one read task takes, about.
TASK_BYTES = 64 << 20


def header(path: str) -> dict:
    with open(path, "rb") as f:
        bin_size, kind, n = np.frombuffer(f.read(12), "<i4").tolist()
        tiles = np.frombuffer(f.read(4 * n), "<i4")
        counts = np.frombuffer(f.read(4 * int(tiles.sum())), "<i4")
        names = [f.read(NAME_BYTES).split(b"\0")[0].decode() for _ in range(n)]
        return {"bin_size": bin_size, "has_value": kind == 1, "tiles": tiles, "counts": counts, "contigs": names, "data": f.tell(), "record": 16 if kind == 1 else 12}


class _Part(InputPartition):
    """Tiles ``first`` to ``last`` - 1 of all. ``begin`` is the first tile of the range that they belong to, and ``before`` the last
    tile of the range before it in the same contig, -1 for none."""

    def __init__(self, first: int, last: int, begin: int = -1, before: int = -1):
        self.first, self.last, self.begin, self.before = first, last, begin, before


class _Reader(DataSourceReader):
    def __init__(self, path: str, copies: bool, ranges: list | None):
        self.path, self.copies, self.ranges = path, copies, ranges

    def _spans(self, h: dict):
        """(first, last + 1, begin, before) of the tiles to read."""
        if self.ranges is None:
            yield 0, len(h["counts"]), -1, -1
            return
        at = {c: i for i, c in enumerate(h["contigs"])}
        offset = np.r_[0, np.cumsum(h["tiles"])]
        last_of: dict[int, int] = {}
        wanted = sorted((at[c], max(0, lo) // h["bin_size"], max(0, lo, hi - 1) // h["bin_size"]) for c, lo, hi in self.ranges if c in at)
        for i, first, last in wanted:
            first, last = int(offset[i] + first), int(min(offset[i] + last, offset[i + 1] - 1))
            before = last_of.get(i, -1)
            first = max(first, before + 1)
            if first <= last:
                yield first, last + 1, first, before
                last_of[i] = last

    def partitions(self):
        h = header(self.path)
        ends, out = np.cumsum(h["counts"].astype(np.int64)) * h["record"], []
        for first, stop, begin, before in self._spans(h):
            while first < stop:
                start = ends[first - 1] if first else 0
                last = min(stop, max(first + 1, int(np.searchsorted(ends, start + TASK_BYTES, side="right"))))
                out.append(_Part(first, last, begin, before))
                first = last
        return out or [_Part(0, 0)]

    def read(self, part):
        h = header(self.path)
        counts = h["counts"].astype(np.int64)
        skip = int(counts[: part.first].sum())
        mine = counts[part.first : part.last]
        with open(self.path, "rb") as f:
            f.seek(h["data"] + skip * h["record"])
            raw = np.frombuffer(f.read(int(mine.sum()) * h["record"]), "<i4").reshape(-1, h["record"] // 4)
        contig_of = np.repeat(np.arange(len(h["tiles"])), h["tiles"])
        offset = np.r_[0, np.cumsum(h["tiles"])].astype(np.int64)
        at = np.repeat(np.arange(part.first, part.last), mine)
        contig, place = contig_of[at], skip + np.arange(len(raw))
        if not self.copies:
            # The copy in a region's first tile is the region itself; where that isn't read, the first one that is.
            home = offset[contig] + np.maximum(raw[:, 1], 0) // h["bin_size"]
            keep = (home == at) | ((at == part.begin) & (home > part.before) & (home < at))
            raw, contig, at, place = raw[keep], contig[keep], at[keep], place[keep]
        names = pa.DictionaryArray.from_arrays(pa.array(contig, pa.int32()), pa.array(h["contigs"], pa.string())).cast(pa.string())
        value = pa.array(raw[:, 3], pa.int32()) if h["has_value"] else pa.nulls(len(raw), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(at - offset[contig], pa.int64()), pa.array(raw[:, 0], pa.int32()), pa.array(raw[:, 1], pa.int64()), pa.array(raw[:, 2], pa.int64()), value, pa.array(place, pa.int64())],
            ["contig", "tile", "ds_idx", "start", "end", "value", "r_id"],
        )


class TileFile(DataSource):
    """``spark.read.format("tilefile").load(path)``, ``r_id`` being a record's place in the file.

    Option ``copies`` = true also gives the copies in later tiles. Option ``ranges``, a JSON list of (contig, lo, hi), reads only the
    tiles that these touch; each region in them comes once.
    """

    @classmethod
    def name(cls):
        return "tilefile"

    def schema(self):
        return "contig string, tile long, ds_idx int, start long, end long, value int, r_id long"

    def reader(self, schema):
        ranges = self.options.get("ranges")
        return _Reader(self.options["path"].removeprefix("file://"), self.options.get("copies", "false") == "true", None if ranges is None else json.loads(ranges))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileFile)


def write(intervals: DataFrame, path: str, bin_size: int = DEFAULT_BIN) -> None:
    """Write regions with start < end as one file; refuses to overwrite. Contigs take their ids in name order.

    A contig whose name takes 40 bytes or more has no place in the layout and raises a ValueError. Records are sorted by Spark and
    stored once; then every task writes what it holds at its place in the file, so no record passes the driver, which has the
    header only: a number for each tile. A tile that holds very many records is written by several tasks.
    """
    path = path.removeprefix("file://")
    has_value = "value" in intervals.columns
    valid = intervals.where((F.col("start") < F.col("end")) & F.col("contig").isNotNull())
    longer = valid.where(F.octet_length("contig") >= NAME_BYTES).select("contig").head()
    if longer is not None:
        raise ValueError(f"a contig's name takes {NAME_BYTES - 1} bytes at most: {longer.contig}")
    tiled = explode_tiles(valid, bin_size)
    names, per_tile = [], []
    for contig, tile, n in tiled.groupBy("contig", "tile").agg(F.count("*").alias("n")).orderBy("contig", "tile").toLocalIterator():
        if not names or names[-1] != contig:
            names.append(contig)
            per_tile.append([])
        per_tile[-1] += [0] * (tile - len(per_tile[-1])) + [n]
    fields = ["ds_idx", "start", "end", *(["value"] if has_value else [])]
    rows = tiled.withColumn("value", F.coalesce("value", F.lit(0))) if has_value else tiled
    order = ["contig", "tile", "start", "end", "ds_idx", *(["value"] if has_value else [])]
    sorted_rows = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(sorted_rows.select(F.monotonically_increasing_id().alias("at"), *(F.col(c).cast("int").alias(c) for c in fields)), "records")
    # One number for each task that sorted: where its records begin.
    parts = {r.part: r.n for r in kept.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).toLocalIterator()}
    begins, total = {}, 0
    for part in sorted(parts):
        begins[part], total = total, total + parts[part]
    size = 4 * len(fields)
    head = np.array([bin_size, int(has_value), len(names)], "<i4").tobytes() + np.array([len(t) for t in per_tile], "<i4").tobytes() + np.array([n for t in per_tile for n in t], "<i4").tobytes()
    head += b"".join(name.encode().ljust(NAME_BYTES, b"\0") for name in names)
    with open(path, "xb") as f:
        f.write(head)
        f.truncate(len(head) + total * size)

    def place(batches):
        n = 0
        out = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                at = b.column(0).to_numpy()
                part, distinct = np.unique(at >> 33, return_inverse=True)
                pos = np.array([begins[p] for p in part.tolist()], np.int64)[distinct] + (at & ((1 << 33) - 1)) if len(at) else at
                data = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1).astype("<i4")
                # Written at the same place with the same bytes however often a task runs.
                cuts = np.r_[0, np.flatnonzero(np.diff(pos) != 1) + 1, len(pos)] if len(pos) else np.zeros(1, int)
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    raw, to = memoryview(data[i:j].tobytes()), len(head) + int(pos[i]) * size
                    while raw:
                        done = os.pwrite(out, raw, to)
                        raw, to = raw[done:], to + done
                n += len(pos)
        finally:
            os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    wrote = kept.mapInArrow(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    release(kept)
    if wrote != total:
        os.remove(path)
        raise OSError(f"{wrote} of {total} records were written")
