"""Greedy matching without listing the pairs, for dense tables.

A greedy matching takes few of the pairs, so a block of a contig is given its regions and queries and looks for pairs only when
their turn may have come. Queries are kept by classes of length. A region's similarity with a class can't exceed a bound, and waits
in a heap under it; when that comes up, the class' queries that are free and overlap the region are compared, and the best of them
wait under their similarities. So the work grows with rows and with how many queries lie about a region, not with all pairs.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.functions.tiling import div
from spanloom.plans.strategy import small_side
from spanloom.shared import release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block beyond which it isn't left to one task.
HOT_ROWS = 1 << 21
#: Rows of a partition of blocks, about.
PART_ROWS = 1 << 16
#: Copies a row, on average, beyond which blocks are too narrow for their rows.
COPIES = 4
#: Pairs that are kept of a region and a class at once, besides one for each region like it.
KEPT = 16
#: Similarities are in single precision, which may round them up above the bound.
SAFE = 1 + 1e-6

FREE, TAKEN, UNKNOWN = 0, 1, 2
_QUERY, _REGION, _MARK = 0, 1, 2


class _Classes:
    """Queries, given in order of start and id, by classes of length, two for each doubling."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        length = end - start
        of = np.floor(2 * np.log2(length + 1.0)).astype(np.int64)
        self.order = np.argsort(of, kind="stable")
        self.start, self.end, self.length, self.rank = start[self.order], end[self.order], length[self.order], self.order.tolist()
        self.first = np.flatnonzero(np.diff(of[self.order], prepend=-1)).tolist()
        stop = [*self.first[1:], len(start)][: len(self.first)]
        self.starts = [self.start[a:b].tolist() for a, b in zip(self.first, stop, strict=True)]
        self.shortest = [int(self.length[a:b].min()) for a, b in zip(self.first, stop, strict=True)]
        self.longest = [int(self.length[a:b].max()) for a, b in zip(self.first, stop, strict=True)]

    def bound(self, c: int, length: int) -> float:
        """What no similarity of a region of this length with the class exceeds."""
        return SAFE * min(length, self.longest[c]) / max(length, self.shortest[c])

    def best(self, c: int, start: int, end: int, status: np.ndarray, free: bool, kept: int) -> tuple[list[tuple[float, int, int]], bool]:
        """(-similarity, rank, place) of the ``kept`` best overlapping queries that are free, or at least not taken, the best last; and
        whether there are more."""
        a = self.first[c] + bisect_right(self.starts[c], start - self.longest[c])
        b = self.first[c] + bisect_left(self.starts[c], end)
        if a >= b:
            return [], False
        at = status[a:b]
        at = ((at == FREE if free else at != TAKEN) & (self.end[a:b] > start)).nonzero()[0]
        if not len(at):
            return [], False
        at += a
        both = np.minimum(self.end[at], end) - np.maximum(self.start[at], start)
        either = self.length[at] + (end - start) - both
        less = -(both.astype(np.float32) / either.astype(np.float32))
        # Within a class places go by rank, so the first of equals is the one that comes first.
        more = len(at) > kept
        best = less.argsort(kind="stable")[kept - 1 :: -1] if more else less.argsort(kind="stable")[::-1]
        at = at[best].tolist()
        return [(s, self.rank[p], p) for s, p in zip(less[best].tolist(), at, strict=True)], more


def scan(queries: _Classes, status: bytearray, start: list[int], end: list[int], state: bytearray) -> list[tuple[int, int, float]]:
    """(region, place of the query, similarity) of the pairs that a greedy matching takes for certain, of regions in order of start
    and id. Queries and regions of which not all pairs are seen are UNKNOWN in ``status`` and ``state``, and so becomes, in greedy
    order, what meets one while it is free. Of regions with the same ends only the first that isn't taken waits."""
    seen = np.frombuffer(status, np.uint8)
    last = len(queries.first) - 1
    alike: dict[tuple[int, int, int], int] = {}
    of = [alike.setdefault(x, len(alike)) for x in zip(start, end, state, strict=True)]
    waiting: list[list[int]] = [[] for _ in alike]
    for i in range(len(of) - 1, -1, -1):
        waiting[of[i]].append(i)
    group = [x[2] for x in alike]
    heap, taken = [], []
    for (s, e, _), own in zip(alike, waiting, strict=True):
        # From its own length on, bounds fall in both directions.
        c = bisect_left(queries.longest, e - s)
        if c <= last:
            heap.append((-queries.bound(c, e - s), -1, own[-1], None, c, 1))
        if c:
            heap.append((-queries.bound(c - 1, e - s), -1, own[-1], None, c - 1, -1))
    heapify(heap)
    while heap:
        less, rank, i, found, c, step = heappop(heap)
        g = of[i]
        own = waiting[g]
        if not own:
            continue
        if found is None:
            if step and 0 <= c + step <= last:
                heappush(heap, (-queries.bound(c + step, end[i] - start[i]), -1, i, None, c + step, step))
            rest, more = queries.best(c, start[i], end[i], seen, group[g] == UNKNOWN, KEPT + len(own) - 1)
            if not rest:
                continue
        else:
            p, rest, more = found
            if status[p] == FREE and i != own[-1]:
                # Another of these regions has been taken, and the next has its own place among equals.
                heappush(heap, (less, rank, own[-1], found, c, 0))
                continue
            if status[p] == FREE and group[g] == FREE:
                status[p] = state[i] = TAKEN
                taken.append((i, p, -less))
                own.pop()
                if not own:
                    continue
            elif status[p] == FREE:
                status[p] = UNKNOWN
            elif status[p] == UNKNOWN:
                group[g] = UNKNOWN
        i = own[-1]
        while rest:
            less, rank, p = rest.pop()
            if status[p] == FREE or (status[p] == UNKNOWN and group[g] == FREE):
                heappush(heap, (less, rank, i, (p, rest, more), c, 0))
                break
        else:
            if more:
                heappush(heap, (less, -1, i, None, c, 0))
    for own, kind in zip(waiting, group, strict=True):
        for i in own:
            state[i] = kind
    return taken


def _floor(pos: Column, width: int) -> Column:
    return div(pos - F.pmod(pos, F.lit(width)), width)


def _solve(width: int, margin: int, schema: pa.Schema):
    """The function that decides a block. A region or query is seen with all its pairs if it is no longer than the margin and
    overlaps the block and a margin at each side; two margins are given."""

    def solve(key, rows):
        contig, block = key
        rows = rows.combine_chunks()
        lo, hi = block.as_py() * width - margin, (block.as_py() + 1) * width + margin
        kind = rows["__kind"].to_numpy()
        q = rows.filter(pa.array(kind == _QUERY)).sort_by([("start", "ascending"), ("q_id", "ascending")])
        r = rows.filter(pa.array(kind == _REGION)).sort_by([("ds_idx", "ascending"), ("start", "ascending"), ("r_id", "ascending")])
        t = rows.filter(pa.array(kind == _MARK))
        if not r.num_rows:
            return schema.empty_table()

        def places(x):
            start, end = x["start"].to_numpy(), x["end"].to_numpy()
            return start, end, np.where((end - start <= margin) & (start < hi) & (end > lo), FREE, UNKNOWN).astype(np.uint8)

        q_start, q_end, q_state = places(q)
        r_start, r_end, r_state = places(r)
        queries = _Classes(q_start, q_end)
        q_state = q_state[queries.order]
        place = np.empty(len(q_start), np.int64)
        place[queries.order] = np.arange(len(q_start))
        datasets = r["ds_idx"].combine_chunks().dictionary_encode()
        of_r, of_t = datasets.indices.to_numpy(), pa.compute.index_in(t["ds_idx"], datasets.dictionary).fill_null(-1).to_numpy()
        at_t = pa.compute.index_in(t["q_id"], q["q_id"].combine_chunks()).to_numpy()
        by_t = np.argsort(of_t, kind="stable")
        home = (r_start >= lo + margin) & (r_start < hi - margin)
        of_pair, of_left = [], []
        edges = [*np.flatnonzero(np.diff(of_r, prepend=-1)).tolist(), len(of_r)]
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            marks = by_t[slice(*np.searchsorted(of_t[by_t], [of_r[a], of_r[a] + 1]))]
            status, state = bytearray(q_state.tobytes()), bytearray(r_state[a:b].tobytes())
            np.frombuffer(status, np.uint8)[place[at_t[marks]]] = TAKEN
            pairs = scan(queries, status, r_start[a:b].tolist(), r_end[a:b].tolist(), state)
            of_pair += [(a + i, queries.rank[p], sm) for i, p, sm in pairs if home[a + i]]
            of_left.append(a + np.flatnonzero((np.frombuffer(state, np.uint8) == UNKNOWN) & home[a:b]))
        left = np.concatenate(of_left)
        ri = np.concatenate([np.array([x[0] for x in of_pair], np.int64), left])
        qi = pa.array([x[1] for x in of_pair] + [None] * len(left), pa.int64())
        r, q = r.take(ri), q.take(qi)
        sm = pa.array([x[2] for x in of_pair] + [None] * len(left), pa.float32())
        columns = [r["ds_idx"], pa.array([contig.as_py()] * len(ri), schema.field("contig").type), q["q_id"], q["start"], q["end"], r["r_id"], r["start"], r["end"], sm]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return solve


def decided(queries: DataFrame, regions: DataFrame, taken: DataFrame | None, width: int) -> tuple[DataFrame, DataFrame] | None:
    """(pairs that the greedy matching takes, regions of which that isn't certain yet), written, where those of ``taken`` are taken
    already; by blocks of this width. None if too many rows are too long for such blocks.

    ``queries`` (q_id, contig, start, end) with start <= end, ``regions`` (ds_idx, r_id, contig, start, end) with start < end; no
    nulls, and ids are unique.
    """
    length = F.col("end") - F.col("start")
    spans = queries.select("start", "end").unionByName(regions.select("start", "end"))
    n, longest, touched = spans.agg(F.count("*"), F.max(F.when(length <= width // 8, length)), F.sum(length / width)).first()
    margin = max(1, longest or 0)
    if not n or touched + n * (1 + 4 * margin / width) > COPIES * n:
        return None
    null = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    rows = queries.select("contig", F.lit(_QUERY).alias("__kind"), null(regions, "ds_idx"), "q_id", null(regions, "r_id"), long("start", "start"), long("end", "end"))
    rows = rows.unionByName(regions.select("contig", F.lit(_REGION).alias("__kind"), "ds_idx", null(queries, "q_id"), "r_id", long("start", "start"), long("end", "end")))
    if taken is not None:
        rows = rows.unionByName(taken.select("contig", F.lit(_MARK).alias("__kind"), "ds_idx", "q_id", null(regions, "r_id"), long("q_start", "start"), long("q_end", "end")))
    homes = written(regions.select("contig", _floor(F.col("start").cast("long"), width).alias("__block")).distinct(), "homes")
    at = F.sequence(_floor(F.col("start") - 2 * margin, width), _floor(F.col("end") + 2 * margin, width))
    placed = rows.withColumn("__block", F.explode(at)).join(small_side(homes), ["contig", "__block"], "left_semi")
    sizes = written(placed.groupBy("contig", "__block").agg(F.count("*").alias("__n")), "sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    hot = sizes.where(F.col("__n") > HOT_ROWS).select("contig", "__block")
    left = None
    if not hot.isEmpty():
        placed = placed.join(hot, ["contig", "__block"], "left_anti")
        left = regions.withColumn("__block", _floor(F.col("start").cast("long"), width)).join(hot, ["contig", "__block"], "left_semi").drop("__block")
    of = lambda df, c: T.StructField(c, df.schema[c].dataType)
    out = T.StructType([of(regions, "ds_idx"), of(regions, "contig"), of(queries, "q_id"), *(T.StructField(f"q_{c}", T.LongType()) for c in ("start", "end"))])
    out = T.StructType([*out, of(regions, "r_id"), *(T.StructField(f"r_{c}", T.LongType()) for c in ("start", "end")), T.StructField("sm", T.FloatType())])
    # Blocks take long for their bytes, so partitions aren't left to be merged.
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_ROWS)
    found = written(placed.repartition(parts, "contig", "__block").groupBy("contig", "__block").applyInArrow(_solve(width, margin, to_arrow_schema(out)), out), "found")
    unsure = found.where("q_id IS NULL").select("ds_idx", "r_id", "contig", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    left = written(unsure if left is None else unsure.unionByName(left.select(*unsure.columns)), "left")
    release(homes, sizes)
    return found.where("q_id IS NOT NULL"), left
