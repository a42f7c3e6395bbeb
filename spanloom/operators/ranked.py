"""Hit counts without meeting pairs, for dense data and places that hold a large part of all rows.

A region r overlaps a query q with q.start < q.end exactly if q starts before r ends and doesn't end until r has started. As
every query that ends by r's start also starts before r's end, the number of overlapping queries is

    (queries that start before r.end) - (queries that end at or before r.start).

Both are running counts of the queries' boundaries, so sorting boundaries replaces the join, and the work doesn't grow with
the number of hits. Boundaries are collapsed by place first and ranked in coordinate blocks whose offsets come from the
blocks' counts, so no contig, block or place is gathered uncollapsed in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.tiling import DEFAULT_BIN, explode_tiles
from spanloom.operators.matrix import fitting_bin, met
from spanloom.operators.overlap import count_hits, wanted
from spanloom.plans.strategy import small_side
from spanloom.shared import release, written

#: Datasets that a pass counts a matrix's columns for: a running count is kept for each.
DATASETS = 64
#: Pairs a row, of a join by tile, above which ranks are the shorter way: where the two took about as long.
DENSE = 200

#: Order of the marks at one place: regions' ends, queries' boundaries, regions' starts.
_END, _QUERY, _START = 0, 1, 2


def _marks(df: DataFrame, keep: list[str], start: list[Column], end: list[Column]) -> DataFrame:
    both = F.array(F.struct(F.col("start").cast("long").alias("pos"), *start), F.struct(F.col("end").cast("long").alias("pos"), *end))
    return df.select("contig", *keep, F.inline(both))


def count_hits_ranked(queries: DataFrame, intervals: DataFrame, min_value: int = 0, block: int = DEFAULT_BIN) -> DataFrame:
    """(ds_idx, n_hits): as :func:`spanloom.operators.overlap.count_hits`, by ranks.

    Queries with start >= end, for which the counts above don't hold, are few and counted by the join. Nulls in contig, start or
    end match nothing; a null dataset is one of its own; empty tables give no rows.
    """
    placed = F.col("contig").isNotNull()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    q = _marks(queries.where(placed & (F.col("start") < F.col("end"))), [], [one.alias("s"), none.alias("e")], [none.alias("s"), one.alias("e")])
    q = q.groupBy("contig", "pos").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    r = wanted(intervals, min_value).where(placed & (F.col("start") < F.col("end")))
    r = _marks(r, ["ds_idx"], [F.lit(_START).alias("kind")], [F.lit(_END).alias("kind")]).groupBy("contig", "pos", "kind", "ds_idx").agg(F.count("*").alias("n"))
    marks = q.select("contig", "pos", F.lit(_QUERY).alias("kind"), F.lit(None).cast(intervals.schema["ds_idx"].dataType).alias("ds_idx"), none.alias("n"), "s", "e")
    marks = marks.unionByName(r.select("contig", "pos", "kind", "ds_idx", "n", none.alias("s"), none.alias("e")))
    marks = marks.withColumn("block", F.call_function("div", F.col("pos") - F.pmod("pos", F.lit(block)), F.lit(block)))
    before = W.partitionBy("contig").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per_block = marks.groupBy("contig", "block").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    offsets = per_block.select("contig", "block", F.coalesce(F.sum("s").over(before), none).alias("s0"), F.coalesce(F.sum("e").over(before), none).alias("e0"))
    upto = W.partitionBy("contig", "block").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    ranked = marks.withColumns({"s1": F.sum("s").over(upto), "e1": F.sum("e").over(upto)}).where(F.col("kind") != _QUERY).join(offsets, ["contig", "block"])
    part = F.when(F.col("kind") == _END, F.col("s0") + F.col("s1")).otherwise(-(F.col("e0") + F.col("e1"))) * F.col("n")
    odd = count_hits(queries.where(F.col("start") >= F.col("end")), intervals, min_value=min_value)
    both = ranked.groupBy("ds_idx").agg(F.sum(part).alias("n_hits")).unionByName(odd)
    return both.groupBy("ds_idx").agg(F.sum("n_hits").alias("n_hits")).where("n_hits > 0")


def meetings(queries: DataFrame, intervals: DataFrame, bin_size: int = DEFAULT_BIN) -> tuple[int, int]:
    """(pairs that a join by tile would look at, rows that it would move), from both sides' tile histograms."""
    placed = F.col("contig").isNotNull()
    q = explode_tiles(queries.where(placed).select("contig", "start", "end"), bin_size).groupBy("contig", "tile").agg(F.count("*").alias("nq"))
    r = explode_tiles(intervals.where(placed & (F.col("start") < F.col("end"))).select("contig", "start", "end"), bin_size).groupBy("contig", "tile").agg(F.count("*").alias("nr"))
    n = q.join(r, ["contig", "tile"], "full").agg(F.sum(F.col("nq").cast("double") * F.col("nr")), F.sum(F.coalesce("nq", F.lit(0)) + F.coalesce("nr", F.lit(0)))).first()
    return int(n[0] or 0), int(n[1] or 0)


def count_hits_chosen(queries: DataFrame, intervals: DataFrame, min_value: int = 0, bin_size: int = DEFAULT_BIN, dense: int = DENSE) -> DataFrame:
    """(ds_idx, n_hits): by the join where its tiles hold few pairs for their rows, by ranks where they hold more than ``dense`` a
    row, so that the work stays in proportion to the rows at hot places. Both count the same."""
    pairs, rows = meetings(queries, wanted(intervals, min_value), bin_size)
    if pairs > dense * rows:
        return count_hits_ranked(queries, intervals, min_value, bin_size)
    return count_hits(queries, intervals, min_value=min_value, bin_size=bin_size)


def hit_matrix_ranked(intervals: DataFrame, value_above: int = 0, block: int = DEFAULT_BIN, bin_size: int | None = None) -> DataFrame:
    """(ds_a, ds_b, n): as :func:`spanloom.operators.matrix.hit_matrix`, by ranks.

    Every boundary is met with the running counts of all datasets' boundaries, so the work grows with rows times datasets and
    not with overlaps. A pass counts DATASETS columns of the matrix. With more datasets than that, regions are met tile by tile: those
    of a tile that holds no more regions than there are datasets in pairs, those of a fuller one by ranks, in as many passes as it
    takes; so a tile's work is its regions times the smaller of the two numbers. ``bin_size``, else the mean width, is the tiles'.
    Nulls in contig, start or end match nothing; rows of a null dataset are left out. The driver holds the datasets' ids.
    """
    r = intervals.where(F.col("contig").isNotNull() & F.col("ds_idx").isNotNull() & (F.col("start") < F.col("end")))
    if value_above > 0:
        r = r.where(F.col("value") > value_above)
    names = sorted(x[0] for x in r.select("ds_idx").distinct().toLocalIterator())
    if not names:
        return r.select(F.col("ds_idx").alias("ds_a"), F.col("ds_idx").alias("ds_b"), F.lit(0).cast("long").alias("n")).limit(0)
    if len(names) <= DATASETS:
        own = written(_collapsed(r, [], block), "marks")
        return _columns(own, own, names)
    # Not below the mean width, so that a region has few copies.
    width = bin_size or fitting_bin(r, most=1 << 40)
    tiled = explode_tiles(r.select("contig", "start", "end", "ds_idx"), width, first="first")
    n_rows = tiled.groupBy("contig", "tile").agg(F.count("*").alias("__n"))
    full = written(n_rows.where(F.col("__n") > len(names)).select("contig", "tile"), "full")
    if full.isEmpty():
        release(full)
        return _mirrored(met(tiled, half=True))
    mark = full.withColumn("__full", F.lit(True))
    marked = tiled.join(small_side(mark), ["contig", "tile"], "left")
    cells = [_mirrored(met(marked.where("__full IS NULL").drop("__full"), half=True))]
    # A pair belongs to the later of the two first tiles. Within it, nothing beyond its ends makes a difference.
    low, high = F.col("tile") * width, (F.col("tile") + 1) * width
    begins = F.col("first") == F.col("tile")
    inside = marked.where("__full").select("contig", "tile", "ds_idx", begins.alias("begins"), F.when(begins, F.col("start")).otherwise(low - 1).alias("start"), F.least("end", high).alias("end"))
    own = written(_collapsed(inside, ["tile", "begins"], block).withColumn("contig", F.struct("contig", "tile")).drop("tile"), "marks")
    for k in range(0, len(names), DATASETS):
        # Each written by itself: a plan of all passes would be as long as there are datasets.
        part = names[k : k + DATASETS]
        both = written(_columns(own.where("begins"), own.where("begins"), part), "cells")
        before = written(_columns(own.where("begins"), own.where("NOT begins"), part), "cells")
        cells += both, before, before.select(F.col("ds_b").alias("ds_a"), F.col("ds_a").alias("ds_b"), "n")
    return reduce(DataFrame.unionByName, cells).groupBy("ds_a", "ds_b").agg(F.sum("n").alias("n"))


def _mirrored(half: DataFrame) -> DataFrame:
    """The whole matrix from its cells with ds_a up to ds_b."""
    own, other = (F.struct(F.col(a).alias("ds_a"), F.col(b).alias("ds_b"), "n") for a, b in (("ds_a", "ds_b"), ("ds_b", "ds_a")))
    return half.select(F.inline(F.when(F.col("ds_a") == F.col("ds_b"), F.array(own)).otherwise(F.array(own, other))))


def _collapsed(r: DataFrame, keep: list[str], block: int) -> DataFrame:
    """The regions' boundaries, counted by place."""
    own = _marks(r, [*keep, "ds_idx"], [F.lit(_START).alias("kind")], [F.lit(_END).alias("kind")]).groupBy("contig", *keep, "pos", "kind", "ds_idx").agg(F.count("*").alias("n"))
    return own.withColumn("block", F.call_function("div", F.col("pos") - F.pmod("pos", F.lit(block)), F.lit(block)))


def _columns(own: DataFrame, others: DataFrame, names: list) -> DataFrame:
    """The matrix's cells of the regions of ``own`` with those of ``others`` whose dataset is among ``names``."""
    # Each mark is looked at, and those of the named datasets count for what looks from behind them: ends look at starts before
    # them, starts at ends up to them.
    looks = own.select("contig", "block", "pos", "kind", "ds_idx", "n", F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("side"))
    counted = others.where(F.col("ds_idx").between(names[0], names[-1]))
    seen = counted.select("contig", "block", "pos", F.lit(_QUERY).alias("kind"), "ds_idx", F.lit(0).cast("long").alias("n"), F.col("n").alias("c"), F.col("kind").alias("side"))
    marks = looks.unionByName(seen)
    of = {(i, side): F.sum(F.when((F.col("ds_idx") == F.lit(d)) & (F.col("side") == side), F.col("c"))) for i, d in enumerate(names) for side in (_START, _END)}
    per_block = marks.groupBy("contig", "block").agg(*(F.coalesce(c, F.lit(0)).alias(f"b{i}_{side}") for (i, side), c in of.items()))
    before = W.partitionBy("contig").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("contig", "block", *(F.coalesce(F.sum(f"b{i}_{side}").over(before), F.lit(0)).alias(f"o{i}_{side}") for i, side in of))
    upto = W.partitionBy("contig", "block").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    inside = (F.coalesce(c.over(upto), F.lit(0)).alias(f"r{i}_{side}") for (i, side), c in of.items())
    ranked = marks.select("*", *inside).where(F.col("kind") != _QUERY).join(offsets, ["contig", "block"])
    part = lambda i: F.when(F.col("kind") == _END, F.col(f"o{i}_{_START}") + F.col(f"r{i}_{_START}")).otherwise(-(F.col(f"o{i}_{_END}") + F.col(f"r{i}_{_END}")))
    rows = ranked.groupBy(F.col("ds_idx").alias("ds_a")).agg(*(F.sum(part(i) * F.col("n")).alias(f"n{i}") for i in range(len(names))))
    cells = F.array(*(F.struct(F.lit(d).cast(own.schema["ds_idx"].dataType).alias("ds_b"), F.col(f"n{i}").alias("n")) for i, d in enumerate(names)))
    return rows.select("ds_a", F.inline(cells)).where("n > 0")
