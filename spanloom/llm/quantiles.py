"""Percentiles per group with bounded rank error from summaries that can be combined.

A summary is a table of tuples (keys, v, g, h). Summed up to and including v, g says how many values surely are <= v; summed
from v on, h says how many surely are >= v. Both statements stay true when the tuples of two summaries are put together, so
merging is a union, and when a tuple is dropped whose g goes to its successor and whose h goes to its predecessor, so
compressing loses only the rank interval in between. That interval is the tuple's rank uncertainty, and it is read off the
sums: whatever was lost on the way, in however many merges, is accounted for.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from spanloom.plans.strategy import leaf_tasks, looked_up
from spanloom.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that one leaf summary takes in at once.
CHUNK_ROWS = 1 << 19
_TAKEN = re.compile(r"v|g|h|n|i|r|value|median|rank_error|n_tuples|n_covered|(?:a|b|r|lo|hi)[0-9]+|lo|hi")
#: Value ranges that the open interval of a group is split into where its values are counted exactly.
BLOCKS = 1024


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """One integer a row that tells the keys apart; null is a key."""
    out = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for c in columns:
        e = c.combine_chunks().dictionary_encode(null_encoding="encode")
        e = e if isinstance(e, pa.DictionaryArray) else e.chunk(0)
        out = out * (len(e.dictionary) + 1) + e.indices.to_numpy(zero_copy_only=False)
        _, out = np.unique(out, return_inverse=True)
    return out


def _leaf(table: pa.Table, keys: list[str], eps: float) -> pa.Table:
    """The summary of a chunk: tuples of distinct values, compressed to the permitted uncertainty."""
    v = table["__v"].to_numpy()
    code = _codes([table[k] for k in keys]) if keys else np.zeros(len(v), np.int64)
    order = np.lexsort((v, code))
    v, code = v[order], code[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (code[1:] != code[:-1])]
    at = np.flatnonzero(new)
    g = np.diff(np.r_[at, len(v)])
    v, code, row = v[at], code[at], order[at]
    first = np.r_[True, code[1:] != code[:-1]]
    group = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    total = np.add.reduceat(g, begin)
    upto = np.cumsum(g)
    upto = upto - np.r_[0, upto][begin][group]
    step = np.maximum(1, np.floor(eps * total).astype(np.int64))[group]
    bucket = (upto - 1) // step
    last = np.r_[first[1:], True]
    # A run of equal values that reaches over a bucket's border stays: dropped, it would open a gap of its own size.
    wide = (upto - g) // step != bucket
    keep = np.flatnonzero(first | last | wide | np.r_[bucket[1:] != bucket[:-1], True])
    kept_first, kept_last = first[keep], last[keep]
    low = upto[keep]
    high = total[group[keep]] - (low - g[keep])
    g2 = np.where(kept_first, low, low - np.r_[0, low[:-1]])
    h2 = np.where(kept_last, high, high - np.r_[high[1:], 0])
    out = {k: table[k].combine_chunks().take(pa.array(row[keep])) for k in keys}
    return pa.table(out | {"v": pa.array(v[keep], pa.float64()), "g": pa.array(g2, pa.int64()), "h": pa.array(h2, pa.int64())})


def _compressed(t: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """Put equal values together and drop tuples within the permitted uncertainty. ``t`` must be placed by ``keys``."""
    t = t.groupBy(*keys, "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    by, whole = W.partitionBy(*keys).orderBy("v"), W.partitionBy(*keys)
    run = by.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"__low": F.sum("g").over(run), "__n": F.sum("g").over(whole), "__left": F.sum("h").over(run)})
    step = F.greatest(F.lit(1), F.floor(F.lit(eps) * F.col("__n")))
    t = t.withColumn("__bucket", F.call_function("div", F.col("__low") - 1, step)).withColumn("__high", F.col("__n") - F.col("__left") + F.col("h"))
    edge = F.lead("__bucket").over(by)
    wide = F.call_function("div", F.col("__low") - F.col("g"), step) != F.col("__bucket")
    t = t.withColumn("__keep", edge.isNull() | (edge != F.col("__bucket")) | wide | (F.col("__low") == F.col("g"))).where("__keep")
    g = F.col("__low") - F.coalesce(F.lag("__low").over(by), F.lit(0))
    h = F.col("__high") - F.coalesce(F.lead("__high").over(by), F.lit(0))
    return t.select(*keys, "v", g.alias("g"), h.alias("h"))


def summarise(df: DataFrame, keys: Sequence[str], value: str, eps: float = 0.002, fan_in: int = 32) -> DataFrame:
    """The summary (keys, v, g, h) of ``value`` by ``keys``, built per partition and merged in rounds of ``fan_in``, as many as the
    input's estimated size asks for.

    Each of the rounds and the leaves get an equal part of ``eps``, the permitted share of a group's rows between two kept
    tuples; groups of fewer than 1/eps rows stay exact. A hot group costs each partition one summary, never its rows.
    Null and NaN values are left out; a null key is a key. An empty table gives an empty summary. Values are doubles, so
    integers are exact up to 2**53. Keys must not bear a name that summaries or their results use (v, g, h, n, i, r, value, median,
    rank_error, n_tuples, n_covered, or a, b, r, lo, hi with a number; ValueError); other columns don't matter.
    """
    keys = list(keys)
    if any(_TAKEN.fullmatch(k.lower()) for k in keys):
        raise ValueError("a key has a name that results use")
    rounds, leaves = 1, leaf_tasks(df)
    while fan_in**rounds < leaves:
        rounds += 1
    part = eps / (rounds + 1)
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))

    def leaf(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK_ROWS:
                yield from _leaf(pa.Table.from_batches(held), keys, part).to_batches()
                held, n = [], 0
        if n:
            yield from _leaf(pa.Table.from_batches(held), keys, part).to_batches()

    fields = [df.schema[k] for k in keys] + [T.StructField("v", T.DoubleType()), T.StructField("g", T.LongType()), T.StructField("h", T.LongType())]
    t = rows.mapInArrow(leaf, T.StructType(fields)).withColumn("__node", F.spark_partition_id())
    for r in range(rounds):
        t = t.withColumn("__node", F.call_function("div", F.col("__node"), F.lit(fan_in)) if r < rounds - 1 else F.lit(0))
        t = _compressed(t.repartition(*keys, "__node"), [*keys, "__node"], part)
    return t.drop("__node")


def combine(summary: DataFrame, keys: Sequence[str], eps: float = 0.0) -> DataFrame:
    """Merge a summary to fewer keys, or a union of summaries to the same ones; ``eps`` > 0 compresses it."""
    keys = list(keys)
    return _compressed(summary.select(*keys, "v", "g", "h").repartition(*keys), keys, eps)


def quantiles(summary: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys, n, rank_error, and for each probability i: r<i>, lo<i>, hi<i>).

    r = max(1, ceil(p n)) is the rank, the value of that rank surely lies in [lo, hi], and rank_error bounds how many values
    of the group may lie strictly between two neighbouring tuples. Where lo = hi the value is exact.
    """
    return _ranked(summary, keys, [lambda n, p=p: F.greatest(F.lit(1), F.ceil(n * F.lit(p) - 1e-9)) for p in probabilities])


def _ranked(summary: DataFrame, keys: Sequence[str], ranks) -> DataFrame:
    by, whole = W.partitionBy(*keys).orderBy("v"), W.partitionBy(*keys)
    run = by.rowsBetween(W.unboundedPreceding, 0)
    t = summary.withColumns({"__low": F.sum("g").over(run), "__n": F.sum("g").over(whole), "__left": F.sum("h").over(run)})
    # At most so many values are smaller than v: those that aren't surely v or greater.
    t = t.withColumn("__below", F.col("__left") - F.col("h"))
    t = t.withColumn("__open", F.greatest(F.lit(0), F.coalesce(F.lead("__below").over(by), F.col("__low")) - F.col("__low")))
    out = [F.max("__n").alias("n"), F.max("__open").alias("rank_error")]
    for i, rank in enumerate(ranks):
        r = rank(F.col("__n"))
        out += [
            F.max(r).alias(f"r{i}"),
            F.max(F.when(F.col("__below") <= r - 1, F.col("v"))).alias(f"lo{i}"),
            F.min(F.when(F.col("__low") >= r, F.col("v"))).alias(f"hi{i}"),
        ]
    return t.groupBy(*keys).agg(*out)


def medians(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, rank_error, lo, hi, r0, lo0, hi0, r1, lo1, hi1): bounds of the median, the mean of the middle two values."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    q = _ranked(summary, keys, [lambda n: div(n + 1, 2), lambda n: div(n, 2) + 1])
    return q.withColumns({"lo": (F.col("lo0") + F.col("lo1")) / 2, "hi": (F.col("hi0") + F.col("hi1")) / 2})


def _exact(df: DataFrame, keys: list[str], value: str, bounds: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(keys, extra, __i, __value): the values of the ranks in ``bounds`` (keys, extra, __lo, __hi, __ranks), which lie within __lo and
    __hi; null keys too.

    Only values within the bounds are counted one by one. They are counted by value before they move, and placed in BLOCKS value
    ranges: the ranges' counts tell which holds a rank and how many values precede it, and only those are put in order. So no
    group's values are gathered in one task.
    """
    v, group = F.col(f"`{value}`").cast("double"), [*keys, *extra]
    valid = df.select(*keys, v.alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    near = looked_up(valid, written(bounds.select(*group, "__lo", "__hi", "__ranks"), "bounds"), keys).where("__v <= __hi")
    place = F.least(F.lit(BLOCKS - 1), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BLOCKS))
    block = F.when(F.col("__v") < F.col("__lo"), -1).when(F.col("__hi") > F.col("__lo"), place).otherwise(0).cast("int")
    counts = near.groupBy(*group, "__ranks", block.alias("__block"), F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    counts = written(counts, "near")
    before = W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.groupBy(*group, "__ranks", "__block").agg(F.sum("__c").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    holds = F.exists("__ranks", lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("__n")))
    picked = blocks.where((F.col("__block") >= 0) & holds).select(*group, "__block", "__before")
    same = F.lit(True)
    for k in [*group, "__block"]:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    inside = counts.alias("c").join(picked.alias("p"), same).select("c.*", "__before")
    run = W.partitionBy(*group, "__block").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    upto = inside.withColumn("__u", F.col("__before") + F.sum("__c").over(run))
    each = upto.select(*group, "__v", "__u", F.posexplode("__ranks").alias("__i", "__r"))
    return each.groupBy(*group, "__i").agg(F.min(F.when(F.col("__u") >= F.col("__r"), F.col("__v"))).alias("__value"))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame) -> DataFrame:
    """(keys, median) of the groups in ``bounds`` (rows of :func:`medians`), null keys too."""
    b = bounds.select(*keys, F.least("lo0", "lo1").alias("__lo"), F.greatest("hi0", "hi1").alias("__hi"), F.array("r0", "r1").alias("__ranks"))
    return _exact(df, list(keys), value, b).groupBy(*keys).agg((F.sum("__value") / 2).alias("median"))


def closed_quantiles(df: DataFrame, keys: Sequence[str], value: str, summary: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(keys, i, n, value), exact, of each probability's place i: from the bounds of ``summary`` where they meet, else counted between
    them. Null keys too."""
    keys = list(keys)
    q = quantiles(summary, keys, probabilities)
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"r{i}").alias("r"), F.col(f"lo{i}").alias("__lo"), F.col(f"hi{i}").alias("__hi")) for i in range(len(probabilities))))
    each = written(q.select(*keys, "n", F.inline(rows)), "quantiles")
    exact = _exact(df, keys, value, each.where("__lo < __hi").withColumn("__ranks", F.array("r")), ["i"])
    same = F.col("b.i") == F.col("e.i")
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}"))
    return each.alias("b").join(exact.alias("e"), same, "left").select(*(F.col(f"b.{k}").alias(k) for k in keys), "b.i", "n", F.coalesce("__value", "__lo").alias("value"))


def covered(df: DataFrame, keys: Sequence[str], value: str, summary: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(keys, n, n_tuples, rank_error, n_covered): for how many of the probabilities the value of the true rank lies within the bounds
    of ``summary``, by counting all rows below and up to each bound, and the size of the group's summary. Null keys too."""
    keys = list(keys)
    q = written(quantiles(summary, keys, probabilities), "quantiles")
    counted = looked_up(df.select(*keys, F.col(f"`{value}`").cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)"), q, keys)
    states = [a for i in range(len(probabilities)) for a in (F.count_if(F.col("__v") < F.col(f"lo{i}")).alias(f"a{i}"), F.count_if(F.col("__v") <= F.col(f"hi{i}")).alias(f"b{i}"))]
    ranks = [f"r{i}" for i in range(len(probabilities))]
    found = counted.groupBy(*keys, "n", "rank_error", *ranks).agg(*states)
    within = [((F.col(f"a{i}") < F.col(f"r{i}")) & (F.col(f"b{i}") >= F.col(f"r{i}"))).cast("int") for i in range(len(probabilities))]
    tuples = summary.groupBy(*keys).agg(F.count("*").alias("n_tuples"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}"))
    return found.alias("f").join(tuples.alias("t"), same).select(*(F.col(f"f.{k}").alias(k) for k in keys), "n", "n_tuples", "rank_error", sum(within).alias("n_covered"))


def closed_medians(df: DataFrame, keys: Sequence[str], value: str, summary: DataFrame) -> DataFrame:
    """(keys, n, median), exact: from the bounds of ``summary`` where they meet, else counted between them. Null keys too."""
    bounds = written(medians(summary, keys), "medians")
    exact = exact_medians(df, keys, value, bounds.where("lo < hi"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}"))
    return bounds.alias("b").join(exact.alias("e"), same, "left").select(*(F.col(f"b.{k}").alias(k) for k in keys), "n", F.coalesce("median", "lo").alias("median"))


def shifted_batches(df: DataFrame, group: str, batch: str, value: str, summary: DataFrame, factor: float = 2.0, least_rows: int = 40) -> DataFrame:
    """(group, batch) of the batches with at least ``least_rows`` values whose median is at least ``factor`` times, or at most
    its inverse of, the group's median over all batches.

    Decided by the bounds from ``summary`` (of ``value`` by group and batch). Where they leave it open, and only there, the
    medians are computed exactly. Groups or batches that are null are left out.
    """
    of_batch = medians(summary.where(F.col(group).isNotNull() & F.col(batch).isNotNull()), [group, batch]).where(F.col("n") >= least_rows)
    of_group = medians(combine(summary.where(F.col(group).isNotNull()), [group]), [group])
    g = of_group.select(group, *(F.col(c).alias(f"g_{c}") for c in ("lo", "hi", "lo0", "hi0", "lo1", "hi1", "r0", "r1")))
    both = of_batch.join(g, group)
    lo, hi, g_lo, g_hi = (F.col(c) for c in ("lo", "hi", "g_lo", "g_hi"))
    sure = (lo >= g_hi * factor) | (hi * factor <= g_lo)
    never = (hi < g_lo * factor) & (lo * factor > g_hi)
    both = written(both.withColumn("verdict", F.when(sure, 1).when(never, 0).otherwise(-1)).where("verdict <> 0"), "verdicts")
    open_ = both.where("verdict = -1")
    exact_b = exact_medians(df, [group, batch], value, open_)
    open_g = open_.select(group, *(F.col(f"g_{c}").alias(c) for c in ("lo0", "hi0", "lo1", "hi1", "r0", "r1"))).distinct()
    exact_g = exact_medians(df, [group], value, open_g).withColumnRenamed("median", "g_median")
    settled = exact_b.join(exact_g, group).where((F.col("median") >= F.col("g_median") * factor) | (F.col("median") * factor <= F.col("g_median")))
    return both.where("verdict = 1").select(group, batch).unionByName(settled.select(group, batch))
