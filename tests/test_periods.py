"""Gaps and periods against brute force, with entities above and below the limit of one task."""

import random

import pytest

from spanloom.operators import periods

SCHEMA = "ds_idx int, contig string, start long, end long, gap_start int, __s int"


def brute(rows):
    groups = {}
    for d, c, s, e, *_ in rows:
        if s is not None and e is not None and 0 <= s < e:
            groups.setdefault((d, c), []).append((s, e))
    gaps, spans = [], []
    for k, v in groups.items():
        v.sort()
        lo, hi = v[0]
        for s, e in v[1:]:
            if s > hi:
                gaps.append((*k, hi, s))
                spans.append((*k, lo, hi))
                lo, hi = s, e
            hi = max(hi, e)
        spans.append((*k, lo, hi))
    return sorted(gaps, key=str), sorted(spans, key=str)


def make(seed, n, far):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        s = r.randrange(far)
        rows.append((r.choice([1, 1, 1, 2, None]), r.choice(["a", "a", "b", None]), s, s + r.choice([1, 2, 5, 30, 0, -4]), 7, 8))
    rows += rows[: n // 4] + [(1, "a", None, 5, 0, 0), (1, "a", 5, None, 0, 0), (1, "a", -5, 5, 0, 0)]
    return rows


@pytest.mark.parametrize("hot_rows", [0, 20, 10**6])
@pytest.mark.parametrize("far,block", [(200, 16), (20000, 64), (10**15, 1 << 20)])
def test_brute_force(spark, monkeypatch, hot_rows, far, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    rows = make(far % 1000 + hot_rows, 150, far)
    df = spark.createDataFrame(rows, SCHEMA)
    gaps, spans = brute(rows)
    assert sorted((tuple(x) for x in periods.gaps(df, ["ds_idx", "contig"], hot_rows=hot_rows).collect()), key=str) == gaps
    assert sorted((tuple(x) for x in periods.periods(df, ["ds_idx", "contig"], hot_rows=hot_rows).collect()), key=str) == spans


def test_one_place_repeated(spark):
    df = spark.createDataFrame([(1, "a", 5, 9, 0, 0)] * 500 + [(1, "a", 9, 12, 0, 0), (1, "a", 20, 21, 0, 0)], SCHEMA)
    for hot in (10, 10**6):
        assert [tuple(x) for x in periods.gaps(df, ["ds_idx", "contig"], hot_rows=hot).collect()] == [(1, "a", 12, 20)]
        assert sorted(tuple(x) for x in periods.periods(df, ["ds_idx", "contig"], hot_rows=hot).collect()) == [(1, "a", 5, 12), (1, "a", 20, 21)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for hot in (0, 10):
        assert periods.gaps(df, ["ds_idx", "contig"], hot_rows=hot).count() == 0
        assert periods.periods(df, ["ds_idx", "contig"], hot_rows=hot).count() == 0
