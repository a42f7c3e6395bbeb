"""Overlap joins against brute force and a hand-written fixture."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import matrix, overlap, ranked
from spanloom.operators.ranked import count_hits_ranked, hit_matrix_ranked
from spanloom.plans.strategy import pushed_filters, small_side

REGIONS = "r_id long, contig string, start long, end long, value int, ds_idx int"
QUERIES = "q_id long, contig string, start long, end long"

FIXTURE = [
    (0, "chr1", 100, 200, 5, 0),
    (1, "chr1", 100, 200, 5, 0),
    (2, "chr1", 16380, 16390, 0, 0),
    (3, "chr1", 16384, 16400, 10, 0),
    (4, "chr1", 10, 70000, 900, 1),
    (5, "chr2", 40000, 40010, 1, 1),
    (6, "chr1", 300, 300, 1, 1),
    (7, "chr3", 5, 9, -3, 2),
]


@pytest.mark.parametrize(
    "query,options,want",
    [
        (("chr1", 150, 160), {}, {0: 2, 1: 1}),
        (("chr1", 200, 210), {}, {1: 1}),
        (("chr1", 16384, 16385), {}, {0: 2, 1: 1}),
        (("chr1", 16000, 17000), {}, {0: 2, 1: 1}),
        (("chr1", 150, 150), {}, {0: 2, 1: 1}),
        (("chr2", 100, 50000), {}, {1: 1}),
        (("chr2", 100, 50000), {"compat_empty_first_tile": True}, {}),
        (("chr2", 100, 50000), {"compat_empty_first_tile": True, "min_value": 1}, {1: 1}),
        (("chr9", 1, 10), {}, {}),
        (("chr1", 150, 160), {"min_value": 6}, {1: 1}),
    ],
)
def test_fixture(spark, query, options, want):
    r = spark.createDataFrame(FIXTURE, REGIONS)
    q = overlap.literal_queries(spark, [query])
    assert {x.ds_idx: x.n_hits for x in overlap.count_hits(q, r, **options).collect()} == want


place = st.integers(-50, 400)
region = st.tuples(st.sampled_from(["a", "b", None]), place | st.none(), place | st.none(), st.integers(0, 2))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(region, max_size=25), st.lists(region, max_size=12), st.sampled_from([1, 7, 64, 16384]))
def test_brute_force(spark, regions, queries, bin_size):
    rs = [(i, c, s, e, 1, d) for i, (c, s, e, d) in enumerate(regions)]
    qs = [(i, c, s, e) for i, (c, s, e, _) in enumerate(queries)]
    r = spark.createDataFrame(rs, REGIONS).selectExpr("*", "0 tile", "1 q_id")
    q = spark.createDataFrame(qs, QUERIES).selectExpr("*", "2 r_id", "3 value")
    want = Counter((a[0], b[0]) for a in qs for b in rs if None not in (a[1], a[2], a[3], b[2], b[3]) and a[1] == b[1] and b[2] < b[3] and b[2] < a[3] and b[3] > a[2])
    assert Counter((x.q_id, x.r_id) for x in overlap.pairs(q, r, bin_size=bin_size).collect()) == want
    assert Counter((x.q_id, x.r_id) for x in overlap.pairs(q, r, bin_size=bin_size, broadcast_rows=0).collect()) == want
    per = Counter(rs[b][5] for _, b in want.elements())
    for hits in (overlap.count_hits(q, r, bin_size=bin_size), count_hits_ranked(q, r, block=bin_size)):
        assert {x.ds_idx: x.n_hits for x in hits.collect()} == per


def test_matrix_invariants(spark):
    rows = [(i, f"c{i % 2}", (i * 37) % 500, (i * 37) % 500 + 1 + i % 90, i % 7, i % 3) for i in range(120)] + [(999, "c0", 5, 5, 1, 0)]
    r = spark.createDataFrame(rows, REGIONS)
    want = Counter((a[5], b[5]) for a in rows for b in rows if a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])
    for size in (16, 1024, None):
        got = {(x.ds_a, x.ds_b): x.n for x in matrix.hit_matrix(r, size).collect()}
        assert got == want
    for size in (1, 16, 16384):
        assert {(x.ds_a, x.ds_b): x.n for x in hit_matrix_ranked(r, block=size).collect()} == want
    assert {tuple(x) for x in hit_matrix_ranked(r, 3).collect()} == {tuple(x) for x in matrix.hit_matrix(r, value_above=3).collect()}
    assert hit_matrix_ranked(r.limit(0)).count() == 0
    assert all(want[a, b] == want[b, a] for a, b in want)
    assert matrix.hit_matrix(r, value_above=3).count() and matrix.hit_matrix(r, value_above=99).count() == 0


def test_matrix_of_many_datasets(spark, monkeypatch):
    """More datasets than a pass counts columns for."""
    rows = [(i, f"c{i % 2}", (i * 37) % 300, (i * 37) % 300 + 1 + i % 40, 1, i % 23) for i in range(150)]
    r = spark.createDataFrame(rows, REGIONS)
    monkeypatch.setattr(ranked, "DATASETS", 5)
    want = {tuple(x) for x in matrix.hit_matrix(r).collect()}
    assert {tuple(x) for x in hit_matrix_ranked(r).collect()} == want
    named = r.withColumn("ds_idx", F.concat(F.lit("n"), F.col("ds_idx").cast("string")))
    assert {tuple(x) for x in hit_matrix_ranked(named).collect()} == {(f"n{a}", f"n{b}", n) for a, b, n in want}


@pytest.mark.parametrize("bin_size", [16, 64, None])
def test_matrix_passes_for_full_tiles_only(spark, monkeypatch, bin_size):
    """More datasets than a pass counts: sparse tiles take no pass, full ones agree with brute force."""
    r = random.Random(3)
    rows = [(i, f"c{i % 2}", s := r.choice([r.randrange(-40, 4000), 64, 100 + r.randrange(9)]), s + r.choice([1, 3, 64, 300]), 1, r.randrange(8)) for i in range(160)]
    table = spark.createDataFrame(rows, REGIONS)
    want = Counter((a[5], b[5]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    passes, columns = [], ranked._columns
    monkeypatch.setattr(ranked, "_columns", lambda *a: passes.append(a[2]) or columns(*a))
    monkeypatch.setattr(ranked, "DATASETS", 5)
    assert {(x.ds_a, x.ds_b): x.n for x in hit_matrix_ranked(table, block=32, bin_size=bin_size).collect()} == want
    assert len(passes) == 4
    passes.clear()
    sparse = spark.createDataFrame([(i, "c", i * 1000, i * 1000 + 1500, 1, i) for i in range(40)], REGIONS)
    assert {(x.ds_a, x.ds_b): x.n for x in hit_matrix_ranked(sparse).collect()} == {(i, j): 1 for i in range(40) for j in range(40) if abs(i - j) < 2}
    assert not passes


def test_way_is_chosen(spark):
    """Few pairs a row are joined, very many are counted by ranks; the counts are the same."""
    r = spark.createDataFrame([(i, "c", 0, 50 + i % 7, 1, i % 3) for i in range(600)], REGIONS)
    q = spark.createDataFrame([(i, "c", i % 5, 40 + i % 30) for i in range(600)], QUERIES)
    assert ranked.meetings(q, r) == (360000, 1200)
    want = {tuple(x) for x in overlap.count_hits(q, r).collect()}
    for dense in (10**9, 0):
        assert {tuple(x) for x in ranked.count_hits_chosen(q, r, dense=dense).collect()} == want
    assert ranked.meetings(q.limit(0), r.limit(0)) == (0, 0) and ranked.count_hits_chosen(q.limit(0), r.limit(0)).count() == 0


def test_threshold_needs_values(spark):
    r = spark.createDataFrame(FIXTURE, REGIONS).drop("value")
    q = overlap.literal_queries(spark, [("chr1", 1, 2)])
    with pytest.raises(ValueError):
        overlap.count_hits(q, r, min_value=1)
    assert overlap.count_hits(q, r).count() == 0


def test_region_filter_reaches_the_scan(spark):
    r = spark.read.parquet("/root/testdata/sf0.001/intervals.parquet")
    pushed = pushed_filters(overlap.region(r, "chr1", 10, 20))
    assert "EqualTo(contig,chr1)" in pushed and "LessThan(start,20)" in pushed and "GreaterThan(end,10)" in pushed


def test_small_side_is_checked(spark):
    assert "BroadcastHashJoin" in spark.range(5).join(small_side(spark.range(9), 10), "id")._jdf.queryExecution().executedPlan().toString()
    big = spark.range(50)
    assert small_side(big, 10) is big
