"""All similar pairs between sets: a size-aware overlap join.

Sets of at most ``small`` tokens enumerate their subsets of the size that the threshold demands of a pair; two small sets
are similar exactly where they share such a subset. For a larger set the inverted lists of its rarest tokens are scanned.
The candidates of both ways are united and filtered by their exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.shared import written

EPS = 1e-9
#: How many of the rarest tokens a pair with a larger set must share, beyond what the threshold leaves free; fewer where a pair
#: need not share so many.
SHARED = 3
#: Tokens of one set that are compared at once, about.
CHUNK = 4096
#: Tokens of equal frequency are ordered by this many hash classes, so that a set's rarest tokens can be cut without sorting it.
CLASSES = 16


def _needed(a: Column, b: Column, t: float) -> Column:
    """Common tokens that a Jaccard of ``t`` takes."""
    return F.ceil((a + b) * F.lit(t / (1 + t)) - EPS)


def _elements(rows: DataFrame, key: str, tokens: Sequence[str | Column]) -> DataFrame:
    """(sid, tok), each once. Every part but the last goes with its length, so that different parts never give one token; a null
    part makes the token null."""
    parts = [(F.col(t) if isinstance(t, str) else t).cast("string") for t in tokens]
    long = [x for p in parts[:-1] for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return rows.select(F.col(key).alias("sid"), F.concat(*long, parts[-1]).alias("tok")).where("sid IS NOT NULL AND tok IS NOT NULL").distinct()


def _small_pairs(e: DataFrame, sizes: DataFrame, t: float, small: int) -> DataFrame:
    """Pairs of small sets that share a subset of the size their similarity takes."""
    few = e.join(sizes.where(F.col("n") <= small), "sid").groupBy("sid", "n").agg(F.array_sort(F.collect_list("tok")).alias("toks"))
    partner = few.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(small)))).where((F.least("n", "m") >= F.greatest("n", "m") * F.lit(t) - EPS))
    partner = partner.withColumn("o", _needed(F.col("n"), F.col("m"), t)).where("o BETWEEN 1 AND n")
    # The subsets of o among n places, as bit masks: a constant table, so that no other subsets are ever made.
    table = {n * (small + 1) + o: [sum(1 << i for i in c) for c in combinations(range(n), o)] for n in range(1, small + 1) for o in range(1, n + 1)}
    chosen_masks = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    masks = partner.withColumn("mask", F.explode(F.try_element_at(chosen_masks, (F.col("n") * (small + 1) + F.col("o")).cast("int"))))
    chosen = F.filter("toks", lambda x, i: F.call_function("getbit", F.col("mask"), i) == 1)
    s = masks.select("sid", "n", "m", F.to_json(chosen).alias("subset"))
    a = s.where("n <= m").select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("m").alias("nb"), "subset")
    b = s.where("n >= m").select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("m").alias("na"), "subset")
    ordered = (F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))
    return a.join(b, ["na", "nb", "subset"]).where(ordered).select("a", "b", "na", "nb").distinct()


def _large_pairs(e: DataFrame, sizes: DataFrame, t: float, small: int) -> DataFrame:
    """Candidates with at least one larger set: those that share enough of both sets' rarest tokens.

    Two sets of which one is above ``small`` share at least ceil(t (small + 1)) tokens, so ``shared`` of them or SHARED if that
    is less. A pair of the required overlap shares ``shared`` tokens among the first n - ceil(t n) + ``shared`` of each in any
    common order of the tokens. The order is by frequency, so common tokens' long lists aren't scanned, and tokens of one set
    only are not met at all. Lists are split by the sets' size as well.
    """
    shared = max(1, min(SHARED, math.ceil(t * (small + 1) - EPS)))
    frequency = e.groupBy("tok").agg(F.count("*").alias("df"))
    klass = F.pmod(F.xxhash64("tok"), F.lit(CLASSES))
    met = e.join(frequency, "tok").select("sid", "tok", (F.col("df") * CLASSES + klass).alias("place"))
    per = met.groupBy("sid", "place").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("sid").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(t) - EPS) + shared
    cut = per.withColumn("before", F.coalesce(before, F.lit(0))).join(sizes, "sid").where(F.col("before") < length)
    cut = cut.groupBy("sid", "n").agg(F.max("place").alias("last"))
    # A frequency of 1 meets no one: such tokens take their place in the order, but needn't be listed.
    listed = met.where(F.col("place") >= 2 * CLASSES).join(cut, "sid").where(F.col("place") <= F.col("last"))
    # Sizes of a pair differ by at most one class.
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / t) + EPS) if t < 1 else F.col("n")
    listed = listed.select("sid", "n", "tok", size_class.alias("k"))
    a = listed.select(F.col("sid").alias("a"), F.col("n").alias("na"), "tok", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    b = listed.where(F.col("n") > small).select(F.col("sid").alias("b"), F.col("n").alias("nb"), "tok", "k")
    fits = ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.col("nb") * F.lit(t) - EPS)
    return a.join(b, ["tok", "k"]).where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= shared).drop("c")


def _common(e: DataFrame, sizes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, na, nb, o): the exact overlap of each candidate pair.

    The candidates' sets are split by a hash of the tokens into as many chunks as the largest needs, so a pair moves a row for each
    of its chunks rather than one for each token, and a large set that has many partners spreads over its chunks' keys.
    """
    largest = sizes.agg(F.max("n")).first()[0] or 0
    chunk = F.pmod(F.xxhash64("tok", F.lit(1)), F.lit(max(1, -(-largest // CHUNK)))).alias("chunk")
    wanted = candidates.select(F.col("a").alias("sid")).unionByName(candidates.select(F.col("b").alias("sid"))).distinct()
    chunks = e.join(wanted, "sid", "left_semi").groupBy("sid", chunk).agg(F.collect_list("tok").alias("toks"))
    mine = candidates.join(chunks.select(F.col("sid").alias("a"), "chunk", F.col("toks").alias("ta")), "a")
    met = mine.join(chunks.select(F.col("sid").alias("b"), "chunk", F.col("toks").alias("tb")), ["b", "chunk"])
    return met.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ta", "tb"))).alias("o"))


def similar_sets(rows: DataFrame, key: str, tokens: Sequence[str | Column], threshold: float = 0.7, small: int = 6) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the sets of ``tokens`` by ``key`` with |A and B| / |A or B| >= ``threshold`` (0.5 to 1).

    members(sid, class_id): every set with the id of its class of equal sets, the least id in it. pairs(a, b, similarity):
    classes whose sets are similar but not equal, a < b. So copies of one set never meet each other.
    ``small`` (1 to 12) decides only by which way a pair is found. Rows with a null key or any null part of the token are left out,
    repeated tokens count once, an empty table gives none of either; other columns don't matter. No set is gathered in one
    task: sets are compared in chunks of about CHUNK tokens.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    if not 1 <= small <= 12:
        raise ValueError("small must lie between 1 and 12")
    e = written(_elements(rows, key, tokens), "elements")
    prints = e.groupBy("sid").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tok")).alias("p1"), F.bit_xor(F.xxhash64(F.concat(F.lit("."), "tok"))).alias("p2"))
    classes = prints.groupBy("n", "p1", "p2").agg(F.min("sid").alias("class_id"))
    members = written(prints.join(classes, ["n", "p1", "p2"]).select("sid", "class_id", "n"), "members")
    sizes = members.where("sid = class_id").select("sid", "n")
    single = e.join(sizes.select("sid"), "sid", "left_semi")
    candidates = _small_pairs(single, sizes, threshold, small).unionByName(_large_pairs(single, sizes, threshold, small))
    common = _common(single, sizes, written(candidates, "candidates"))
    scored = common.withColumn("similarity", F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).where(F.col("similarity") >= threshold)
    pairs = scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return pairs, members.select("sid", "class_id")


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of similar sets, those within a class included. As many rows as there are such pairs, so only for
    where every pair is asked for; :func:`links` gives one row a set."""
    m = members.withColumnRenamed("sid", "x")
    within = members.select(F.col("sid").alias("a"), "class_id").join(members.select(F.col("sid").alias("b"), "class_id"), "class_id").where("a < b").select("a", "b")
    left = pairs.select(F.col("a").alias("class_id"), "b").join(m, "class_id").select(F.col("x").alias("left"), F.col("b").alias("class_id"))
    across = left.join(m, "class_id").select(F.least("left", "x").alias("a"), F.greatest("left", "x").alias("b"))
    return within.unionByName(across)


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, class_id, n_links): each set with its class and the number of other sets it is similar to, equal ones included."""
    size = members.groupBy("class_id").agg(F.count("*").alias("n"))
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    beyond = both.join(size.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("n").alias("beyond"))
    out = members.join(size, "class_id").join(beyond, "class_id", "left")
    return out.select("sid", "class_id", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
