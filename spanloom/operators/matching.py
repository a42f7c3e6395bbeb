"""Similarity of a query set with each dataset: greedy one-to-one matching of overlapping regions.

The greedy result within a stretch of a contig hardly depends on what lies far from it. So pairs are placed in coordinate blocks, each
block is scanned once in greedy order, and what a block can't decide for certain, because a region or query reaches out of what the
block sees, is left to wider blocks and in the end to rounds of mutually best pairs. Where pairs are too many to be listed, blocks
look for them themselves (:mod:`spanloom.operators.best_first`).
"""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.tiling import DEFAULT_BIN, div
from spanloom.operators import best_first
from spanloom.operators.overlap import pair_similarity, wanted
from spanloom.operators.ranked import meetings
from spanloom.shared import cut, release, written, written_alone

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Widths of the blocks, one pass for each.
WIDTHS = (1 << 20, 1 << 25)
#: Blocks that a region may touch and still be placed in all of them.
TOUCHED = 4
#: Pairs of a block beyond which it isn't scanned by one task.
HOT_PAIRS = 1 << 19
#: Pairs that are written at once, or as many as there are rows, and the steps of similarity that bands are made of.
PAIRS, STEPS = 1 << 24, 1 << 14
#: Pairs beyond which they aren't listed at all, but looked for by blocks.
LISTED = 1 << 24

_COLUMNS = ["ds_idx", "contig", "q_id", "q_start", "q_end", "r_id", "r_start", "r_end", "sm"]


def _block(pos: Column, width: int) -> Column:
    return div(pos - F.pmod(pos, F.lit(width)), width)


def _placed(pairs: DataFrame, width: int) -> DataFrame:
    """The pairs with what blocks they go to: every block that their query touches and every one that their region touches, unless
    that touches more than TOUCHED. A pair's home is a block that sees all pairs of both, or of the one that isn't so long."""
    spans = {f"__{s}{i}": c for s in "qr" for i, c in enumerate((_block(F.col(f"{s}_start"), width), _block(F.greatest(f"{s}_start", F.col(f"{s}_end") - 1), width)))}
    p = pairs.withColumns(spans)
    q_narrow, r_narrow = (F.col(f"__{s}1") - F.col(f"__{s}0") < TOUCHED for s in "qr")
    # They overlap, so the blocks of both are neighbours.
    low = F.when(q_narrow & r_narrow, F.least("__q0", "__r0")).when(q_narrow, F.col("__q0")).when(r_narrow, F.col("__r0"))
    high = F.when(q_narrow & r_narrow, F.greatest("__q1", "__r1")).when(q_narrow, F.col("__q1")).when(r_narrow, F.col("__r1"))
    home = F.when(q_narrow & r_narrow, F.greatest("__q0", "__r0")).when(q_narrow, F.col("__q0")).when(r_narrow, F.col("__r0"))
    return p.withColumns({"__qn": q_narrow, "__rn": r_narrow, "__home": home, "__to": F.sequence(low, high)})


def _scan(batches):
    """Decide the pairs of each block in greedy order. A query or region of which not all pairs are seen (``__qc``, ``__rc``) may be
    taken by one that isn't, and so may all that then depends on it."""
    group, of_q, of_r = None, {}, {}
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(b.schema.get_field_index(c)) for c in ("ds_idx", "contig", "__block")]
        changes = pa.compute.equal(key[2].slice(1), key[2].slice(0, b.num_rows - 1))
        for k in key[:2]:
            changes = pa.compute.and_(changes, pa.compute.equal(k.slice(1), k.slice(0, b.num_rows - 1)))
        # Rows are in order by these columns, so a batch begins with the last one's group or a new one.
        first, last = (tuple(k[i].as_py() for k in key) for i in (0, -1))
        begins = [first != group, *pa.compute.invert(changes).to_pylist()]
        group = last
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("q_id", "r_id", "__qc", "__rc")]
        verdict = []
        for new, q, r, q_seen, r_seen in zip(begins, *columns, strict=True):
            if new:
                of_q, of_r = {}, {}
            # 0 free, 1 taken, 2 unknown.
            a, c = of_q.get(q, 0), of_r.get(r, 0)
            if a == 1 or c == 1:
                verdict.append(0)
            elif q_seen and r_seen and not a and not c:
                of_q[q] = of_r[r] = 1
                verdict.append(1)
            else:
                if q_seen:
                    of_q[q] = 2
                if r_seen:
                    of_r[r] = 2
                verdict.append(2)
        out = pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in _COLUMNS), pa.array(verdict, pa.int32())], [*_COLUMNS, "__verdict"])
        home = b.column(b.schema.get_field_index("__here"))
        yield out.filter(pa.compute.and_(home, pa.compute.greater(out.column(len(_COLUMNS)), 0)))


def _pass(left: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(taken pairs, pairs left) after all blocks of this width have been scanned."""
    placed = _placed(left, width)
    # An outer explode, since for an inner one the optimizer repeats all these expressions in a filter.
    copies = placed.select(*_COLUMNS, "__q0", "__q1", "__r0", "__r1", "__qn", "__rn", "__home", F.explode_outer("__to").alias("__block")).where("__block IS NOT NULL")
    hot = written(copies.groupBy("ds_idx", "contig", "__block").agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_PAIRS), "hot")
    longer = lambda s: F.col(f"{s}_end") - F.col(f"{s}_start") > (TOUCHED - 1) * width
    alone = _placed(left.where(longer("q") & longer("r")), width).where("NOT __qn AND NOT __rn").select(*_COLUMNS)
    if not hot.isEmpty():
        # One row in each HOT_PAIRS pairs at most.
        mark = hot.select("ds_idx", "contig", "__block", F.lit(True).alias("__hot"))
        copies = _marked(copies, mark, "__block").where("__hot IS NULL").drop("__hot")
        at_home = _marked(placed.where("__home IS NOT NULL").select(*_COLUMNS, "__home"), mark.withColumnRenamed("__block", "__home"), "__home")
        alone = alone.unionByName(at_home.where("__hot").select(*_COLUMNS))
    seen = lambda s: F.col(f"__{s}n") & F.col("__block").between(F.col(f"__{s}0"), F.col(f"__{s}1"))
    copies = copies.select(*_COLUMNS, "__block", seen("q").alias("__qc"), seen("r").alias("__rc"), (F.col("__block") == F.col("__home")).alias("__here"))
    key = ["ds_idx", "contig", "__block"]
    ordered = copies.repartition(*key).sortWithinPartitions(*key, F.desc("sm"), "q_start", "q_id", "r_start", "r_id")
    schema = left.select(*_COLUMNS).schema.add("__verdict", T.IntegerType())
    decided = written(ordered.mapInArrow(_scan, schema), "decided")
    taken = decided.where("__verdict = 1").drop("__verdict")
    return taken, _without(decided.where("__verdict = 2").drop("__verdict").unionByName(alone), taken)


def _marked(pairs: DataFrame, mark: DataFrame, block: str) -> DataFrame:
    on = ["ds_idx", "contig", block]
    return pairs.join(F.broadcast(mark), on, "left") if mark.count() <= 100_000 else pairs.join(mark, on, "left")


def _without(left: DataFrame, taken: DataFrame) -> DataFrame:
    """The pairs of which neither side is taken."""
    return left.join(taken.select("ds_idx", "q_id"), ["ds_idx", "q_id"], "left_anti").join(taken.select("ds_idx", "r_id"), ["ds_idx", "r_id"], "left_anti").select(*_COLUMNS)


def _rounds(left: DataFrame) -> DataFrame | None:
    """All pairs that are best for both their query and their region, round by round. A round is two aggregates, combined before
    their shuffle, so that a query that meets very many regions isn't gathered; what remains is checkpointed."""
    done = None
    while not left.isEmpty():
        of_q = left.groupBy("ds_idx", "q_id").agg(F.min_by(F.struct(*_COLUMNS), F.struct((-F.col("sm")).alias("m"), "r_start", "r_id")).alias("b")).select("b.*")
        of_r = left.groupBy("ds_idx", "r_id").agg(F.min_by("q_id", F.struct((-F.col("sm")).alias("m"), "q_start", "q_id")).alias("q_id"))
        taken = cut(of_q.join(of_r, ["ds_idx", "q_id", "r_id"]).select(*_COLUMNS))
        done = taken if done is None else done.unionByName(taken)
        left = cut(_without(left, taken))
    return done


def match(candidates: DataFrame) -> DataFrame:
    """Greedy matching of candidate pairs (ds_idx, contig, q_id, q_start, q_end, r_id, r_start, r_end, sm), per dataset, greatest
    ``sm`` first; the matched pairs come back.

    Ties go to the earlier query, then its id, then the earlier region, then its id. Ids must be unique in their tables; pairs with
    a null in any id or dataset are left out, repeated candidates match once, an empty input gives no rows. A block of a contig
    holds at most HOT_PAIRS pairs of a dataset in one task; pairs of fuller blocks, and chains that no block decides, are
    matched by rounds.
    """
    left = written(candidates.select(*_COLUMNS).where("ds_idx IS NOT NULL AND q_id IS NOT NULL AND r_id IS NOT NULL"), "candidates")
    done = []
    for width in WIDTHS:
        before = left
        taken, left = _pass(before, width)
        left = written(left, "left")
        release(before)
        done.append(taken)
        if left.isEmpty():
            break
    else:
        last = _rounds(left)
        done += [] if last is None else [last]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _in_bands(queries: DataFrame, regions: DataFrame, most: int, taken: tuple[DataFrame, ...] = (), **options) -> DataFrame:
    """The greedy matching of all overlapping pairs, after the pairs ``taken`` and with them, of which only about ``most`` at a time are written: those of the greatest
    similarities first, then those of the next among what these have left. As pairs of one similarity are never parted, that is the
    order in which all would be looked at. Each band counts the pairs that are left and meets them again."""
    regions = written(regions, "regions")
    step = F.floor(F.col("sm").cast("double") * STEPS).cast("int")
    done, below = list(taken), STEPS + 1
    while True:
        pairs = pair_similarity(queries, regions, **options).where("ds_idx IS NOT NULL AND q_id IS NOT NULL AND r_id IS NOT NULL").where(step < below)
        # At most STEPS + 1 rows, counted within the join's stage.
        counts = {r.step: r.n for r in pairs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        n, low = 0, below
        for k in sorted(counts, reverse=True):
            if low < below and n + counts[k] > most:
                break
            n, low = n + counts[k], k
        band = pairs.where(step >= low).select(*_COLUMNS)
        for earlier in done:
            band = band.join(earlier.select("ds_idx", "q_id"), ["ds_idx", "q_id"], "left_anti")
        done.append(written_alone(lambda: match(band), "taken"))  # noqa: B023
        below = low
        if low == min(counts):
            break
        before, regions = regions, written(regions.join(done[-1].select("ds_idx", "r_id"), ["ds_idx", "r_id"], "left_anti"), "regions")
        release(before)
    release(regions)
    return reduce(DataFrame.unionByName, done) if done else match(pairs)


def _unlisted(queries: DataFrame, regions: DataFrame, most: int, min_value: int = 0, **options) -> DataFrame:
    """The greedy matching of all overlapping pairs without a list of them, but of those that blocks of no width decide."""
    placed = "contig IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND"
    q = queries.select("q_id", "contig", "start", "end").where(f"{placed} q_id IS NOT NULL")
    left = wanted(regions, min_value).select("ds_idx", "r_id", "contig", "start", "end").where(f"{placed} start < end AND r_id IS NOT NULL AND ds_idx IS NOT NULL")
    done = []
    for width in WIDTHS:
        found = best_first.decided(q, left, reduce(DataFrame.unionByName, done) if done else None, width)
        if found:
            done.append(found[0])
            left = found[1]
            if left.isEmpty():
                return reduce(DataFrame.unionByName, done)
    return _in_bands(q, left, most, tuple(done), **options)


def match_sums(queries: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """(ds_idx, sm_sum, n_matched) of the greedy matching. Where the tiles of both sides may hold more pairs than PAIRS and than they
    have rows, it goes by bands of similarity, so that never all pairs are written; beyond LISTED, by blocks that look for pairs."""
    kept = queries.where((F.col("start") >= 0) & (F.col("start") <= F.col("end")))
    pairs, rows = meetings(kept, intervals, options.get("bin_size", DEFAULT_BIN))
    most = max(PAIRS, rows)
    if pairs > max(LISTED, most) and not options.get("compat_empty_first_tile"):
        matched = _unlisted(kept, intervals, most, **options)
    elif pairs > most:
        matched = _in_bands(kept, intervals, most, **options)
    else:
        matched = match(pair_similarity(kept, intervals, **options))
    return matched.groupBy("ds_idx").agg(F.sum(F.col("sm").cast("double")).alias("sm_sum"), F.count("*").alias("n_matched"))


def similarity(queries: DataFrame, intervals: DataFrame, **options) -> DataFrame:
    """(ds_idx, n_regions, similarity): S / (Nq + Nr - S) of every dataset that has rows.

    S sums the matched pairs' Jaccard, Nq counts the queries with 0 <= start <= end, Nr the dataset's rows, dropped ones
    included. A dataset without matches has 0.
    """
    kept = queries.where((F.col("start") >= 0) & (F.col("start") <= F.col("end")))
    n_q = kept.count()
    sums = match_sums(queries, intervals.where(F.col("start") < F.col("end")), **options)
    rows = intervals.groupBy("ds_idx").agg(F.count("*").alias("n_regions"))
    s = F.coalesce(F.col("sm_sum"), F.lit(0.0))
    return rows.join(sums, "ds_idx", "left").select("ds_idx", "n_regions", (s / (F.lit(n_q) + F.col("n_regions") - s)).alias("similarity"))
