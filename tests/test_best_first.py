"""Greedy matching that doesn't list the pairs."""

import pytest
from test_matching import Q, R, dense, greedy

from spanloom.operators import best_first, matching, overlap


def by_blocks(monkeypatch, widths):
    monkeypatch.setattr(matching, "WIDTHS", widths)
    monkeypatch.setattr(matching, "PAIRS", 10)
    monkeypatch.setattr(matching, "LISTED", 10, raising=False)


def check(spark, queries, regions, **options):
    q, r = spark.createDataFrame(queries, Q), spark.createDataFrame(regions, R)
    pairs = overlap.pair_similarity(q.where("start >= 0 AND start <= end"), r, **options).where("q_id IS NOT NULL AND r_id IS NOT NULL").collect()
    of, sm = greedy(pairs), {(p.ds_idx, p.q_id, p.r_id): p.sm for p in pairs}

    def same():
        got = {x.ds_idx: (x.n_matched, x.sm_sum) for x in matching.match_sums(q, r, **options).collect()}
        assert {d: n for d, (n, _) in got.items()} == {d: n for d in (0, 1) if (n := sum(p[0] == d for p in of))}
        assert all(abs(x - sum(sm[p] for p in of if p[0] == d)) < 1e-6 for d, (_, x) in got.items())

    return same


def test_pairs_are_not_listed(spark, monkeypatch):
    """Dense tables are matched without a join by tile, borders of blocks included."""
    queries, regions = dense(n=300, places=600)
    by_blocks(monkeypatch, (320, 1 << 12))
    same = check(spark, [*queries, (98, "c", -4, 9), (99, "c", 9, 4), (None, "c", 1, 9), (97, None, 1, 9)], [*regions, (1000, "d", 0, 9, 1, 0), (None, "c", 0, 9, 1, 0)])
    monkeypatch.setattr(matching, "pair_similarity", lambda *a, **k: 1 / 0)
    same()


@pytest.mark.parametrize("widths,hot,kept", [((320,), 1 << 21, 1), ((160, 640), 1 << 21, 3), ((320, 640), 60, 16), ((8,), 1 << 21, 16)])
@pytest.mark.parametrize("long", [0, 4])
def test_what_blocks_leave(spark, monkeypatch, widths, hot, kept, long):
    """Rows too long for the blocks, blocks of too many rows and widths that don't fit leave what the bands then match."""
    by_blocks(monkeypatch, widths)
    monkeypatch.setattr(best_first, "HOT_ROWS", hot)
    monkeypatch.setattr(best_first, "KEPT", kept)
    check(spark, *dense(seed=long + kept, n=120, places=900, long=long))()


def test_threshold(spark, monkeypatch):
    queries, regions = dense(n=120)
    by_blocks(monkeypatch, (1 << 12,))
    check(spark, queries, [(*r[:4], i % 3, r[5]) for i, r in enumerate(regions)], min_value=2)()
