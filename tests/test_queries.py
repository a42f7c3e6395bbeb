"""Every registered core query against its SQL on the smallest tables."""

import math
from collections import Counter

import numpy as np
import pytest
from oracle import SF, differences

from spanloom import queries as Q
from spanloom import store_queries as S


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    assert name in Q.SQL
    _, wrong = differences(spark, Q.QUERIES[name], Q.SQL[name])
    assert not wrong


@pytest.mark.parametrize("name", sorted(S.QUERIES))
def test_store_query(spark, name):
    _, wrong = differences(spark, S.QUERIES[name], S.SQL[name])
    assert not wrong


def test_names_differ():
    assert not set(Q.QUERIES) & set(S.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_orders(spark):
    """Every order queries, whatever its id: hits by brute force."""
    orders = Q.table(spark, SF, "orders").collect()
    assert len(orders) == Q.order_queries(spark, SF).count()
    by = {}
    for o in orders:
        start = math.floor(o.o_totalprice * 5)
        by.setdefault(f"chr{o.o_custkey % 50}", []).append((start, start + 200 + o.o_orderkey % 9 * 9000))
    by = {c: np.array(x, np.int64) for c, x in by.items()}
    for regions, names in ((Q.events_regions, ["count_hits_events"]), (Q.line_regions, ["count_hits_lineitem", "count_hits_ranked_lineitem"])):
        want = Counter()
        for r in regions(spark, SF).collect():
            if r.contig in by and r.start < r.end:
                q = by[r.contig]
                want[r.ds_idx] += int(((r.start < q[:, 1]) & (r.end > q[:, 0])).sum())
        for name in names:
            assert {r.ds_idx: r.n_hits for r in Q.QUERIES[name](spark, SF).collect()} == {k: n for k, n in want.items() if n}
