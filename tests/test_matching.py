"""Greedy matching against a sequential scan."""

import random

import pytest

from spanloom.operators import matching, overlap

R = "r_id long, contig string, start long, end long, value int, ds_idx int"
Q = "q_id long, contig string, start long, end long"


def greedy(pairs):
    want, used_q, used_r = set(), set(), set()
    for p in sorted(pairs, key=lambda p: (-p.sm, p.q_start, p.q_id, p.r_start, p.r_id)):
        if (p.ds_idx, p.q_id) not in used_q and (p.ds_idx, p.r_id) not in used_r:
            used_q.add((p.ds_idx, p.q_id))
            used_r.add((p.ds_idx, p.r_id))
            want.add((p.ds_idx, p.q_id, p.r_id))
    return want


def dense(seed=2, n=60, places=300, long=0):
    r = random.Random(seed)
    regions = [(i, "c", s := r.randrange(-20, places), s + r.choice([5, 10, 20]), 1, i % 2) for i in range(n)]
    queries = [(i, "c", s := r.randrange(places), s + r.choice([0, 5, 10, 40])) for i in range(n // 2)]
    regions += [(1000 + i, "c", r.randrange(places), places * 2, 1, 0) for i in range(long)]
    queries += [(1000 + i, "c", 0, r.randrange(1, places * 2)) for i in range(long)]
    return queries, regions


@pytest.mark.parametrize("widths,hot", [((1 << 20, 1 << 25), 1 << 19), ((16, 256), 1 << 19), ((1,), 1 << 19), ((7, 11), 5), ((64,), 0)])
@pytest.mark.parametrize("long", [0, 6])
def test_blocks(spark, monkeypatch, widths, hot, long):
    """The same matches whatever the blocks: regions and queries over borders, over very many blocks, in blocks too full to scan."""
    monkeypatch.setattr(matching, "WIDTHS", widths)
    monkeypatch.setattr(matching, "HOT_PAIRS", hot)
    queries, regions = dense(long=long)
    pairs = overlap.pair_similarity(spark.createDataFrame(queries, Q), spark.createDataFrame(regions, R), bin_size=16)
    got = [(x.ds_idx, x.q_id, x.r_id) for x in matching.match(pairs.unionByName(pairs.limit(5))).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(pairs.collect())


@pytest.mark.parametrize("steps", [3, 64])
def test_bands(spark, monkeypatch, steps):
    """Many pairs are matched by bands of similarity, none of which holds them all, as if all were scanned in one order."""
    monkeypatch.setattr(matching, "PAIRS", 40)
    monkeypatch.setattr(matching, "STEPS", steps)
    queries, regions = dense(n=120)
    q, r = spark.createDataFrame(queries, Q).where("start <= end"), spark.createDataFrame(regions, R)
    pairs = overlap.pair_similarity(q, r).collect()
    of, sm = greedy(pairs), {(p.ds_idx, p.q_id, p.r_id): p.sm for p in pairs}
    sizes, match = [], matching.match
    monkeypatch.setattr(matching, "match", lambda c: sizes.append(c.count()) or match(c))
    got = {x.ds_idx: (x.n_matched, x.sm_sum) for x in matching.match_sums(q, r).collect()}
    assert {d: n for d, (n, _) in got.items()} == {d: sum(p[0] == d for p in of) for d in (0, 1)}
    assert all(abs(x - sum(sm[p] for p in of if p[0] == d)) < 1e-6 for d, (_, x) in got.items())
    assert len(sizes) > 1 and max(sizes) < len(pairs)


def test_chain(spark, monkeypatch):
    """A chain in which every pair is beaten by the next is decided in one scan, not in a round for each link."""
    monkeypatch.setattr(matching, "_rounds", lambda left: 1 / 0)
    rows = [(i, "c", 100 * i, 100 * i + 101 + i, 1, 0) for i in range(16)]
    df = spark.createDataFrame(rows, R)
    q = spark.createDataFrame([(i, "c", 100 * i + 50, 100 * i + 151 + i) for i in range(16)], Q)
    pairs = overlap.pair_similarity(q, df)
    assert {(x.ds_idx, x.q_id, x.r_id) for x in matching.match(pairs).collect()} == greedy(pairs.collect())


def test_nulls_are_left_out(spark):
    c = "ds_idx int, contig string, q_id long, q_start long, q_end long, r_id long, r_start long, r_end long, sm float, value int"
    df = spark.createDataFrame([(None, "c", 1, 1, 5, 1, 1, 5, 1.0, 1), (1, "c", None, 1, 5, 1, 1, 5, 1.0, 1), (1, "c", 1, 1, 5, None, 1, 5, 1.0, 1), (1, "c", 2, 1, 5, 3, 1, 4, 0.75, 1)], c)
    assert [(x.q_id, x.r_id) for x in matching.match(df).collect()] == [(2, 3)]


def test_greedy(spark):
    queries, regions = dense(5)
    queries += [(98, "c", -4, 9), (99, "c", 9, 4)]
    q, df = spark.createDataFrame(queries, Q), spark.createDataFrame(regions, R)
    pairs = overlap.pair_similarity(q.where("start >= 0 AND start <= end"), df, bin_size=16).collect()
    chosen = greedy(pairs)
    want = {}
    for p in pairs:
        if (p.ds_idx, p.q_id, p.r_id) in chosen:
            s, n = want.get(p.ds_idx, (0.0, 0))
            want[p.ds_idx] = s + p.sm, n + 1
    got = {x.ds_idx: (x.sm_sum, x.n_matched) for x in matching.match_sums(q, df, bin_size=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in want)


def test_self_and_empty(spark):
    rows = [(i, "c", 10 * i, 10 * i + 7, 1, 0) for i in range(9)]
    df = spark.createDataFrame(rows, R)
    q = df.selectExpr("r_id q_id", "contig", "start", "end")
    assert [x.similarity for x in matching.similarity(q, df).collect()] == [1.0]
    assert [x.similarity for x in matching.similarity(q.limit(0), df).collect()] == [0.0]
    assert matching.match_sums(q, df.limit(0)).count() == 0
