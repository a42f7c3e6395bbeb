"""Summaries: exact ranks, bounds under merging, combination of batches."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import quantiles

SCHEMA = "k string, b int, x double, v string, n int"


def rows(n=6000, seed=1):
    r = np.random.default_rng(seed)
    g = r.choice(["hot", "hot", "hot", "a", "b"], n)
    x = np.round(r.lognormal(6, 1.5, n), 0)
    x[:400] = 77.0
    out = [(str(k), int(i % 7), float(v), "v", 1) for i, (k, v) in enumerate(zip(g, x, strict=True))]
    return out + [("a", 0, None, "v", 1), ("a", 0, float("nan"), "v", 1), (None, None, 3.0, "v", 1), ("lone", 1, None, "v", 1)]


def groups(data, keys):
    out = {}
    for g, b, x, *_ in data:
        if x is not None and x == x:
            out.setdefault(tuple({"k": g, "b": b}[k] for k in keys), []).append(x)
    return {k: np.sort(v) for k, v in out.items()}


@pytest.mark.parametrize("eps,parts,fan_in", [(0.05, 13, 3), (0.01, 5, 32), (0.2, 40, 2), (1e-9, 3, 2)])
def test_bounds(spark, monkeypatch, eps, parts, fan_in):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    s = quantiles.summarise(df, ["k", "b"], "x", eps, fan_in)
    assert s.groupBy("k", "b").agg({"g": "sum"}).count() == len(groups(data, ["k", "b"]))
    whole = quantiles.combine(s, ["k"], eps)
    ps = [0.0, 0.01, 0.5, 0.9, 1.0]
    for summary, keys, times in ((s, ["k", "b"], 1), (whole, ["k"], 2)):
        want = groups(data, keys)
        got = {tuple(r[k] for k in keys): r for r in quantiles.quantiles(summary, keys, ps).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            r = got[k]
            assert r.n == len(v) and r.rank_error <= times * eps * len(v) + 1
            for i, p in enumerate(ps):
                rank = max(1, int(np.ceil(p * len(v) - 1e-9)))
                assert r[f"r{i}"] == rank and r[f"lo{i}"] <= v[rank - 1] <= r[f"hi{i}"]
                if eps < 1e-6:
                    assert r[f"lo{i}"] == r[f"hi{i}"]


def test_compression_and_exact(spark):
    data = rows(20000)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    s = quantiles.summarise(df, ["k"], "x", 0.05, 4)
    assert s.where("k = 'hot'").count() < 150
    bounds = quantiles.medians(s, ["k"])
    exact = {r.k: r.median for r in quantiles.exact_medians(df, ["k"], "x", bounds).collect()}
    assert exact == {k[0]: float(np.median(v)) for k, v in groups(data, ["k"]).items()}


@pytest.mark.parametrize("broadcast,blocks", [(10**6, 1024), (0, 3), (10**6, 1)])
def test_closed_quantiles(spark, monkeypatch, broadcast, blocks):
    """Exact values of ranks, with the bounds broadcast or met under salts, in many value ranges or one; covered by the bounds."""
    real = quantiles.looked_up
    monkeypatch.setattr(quantiles, "looked_up", lambda rows, table, keys: real(rows, table, keys, broadcast))
    monkeypatch.setattr(quantiles, "BLOCKS", blocks)
    data = [*rows(9000), ("a", 0, float("inf"), "v", 1), ("a", 0, float("-inf"), "v", 1), ("far", 0, 1e300, "v", 1), ("far", 0, -1e300, "v", 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    ps = [0.0, 0.02, 0.5, 0.77, 1.0]
    s = quantiles.summarise(df, ["k"], "x", 0.1, 4)
    got = {(r.k, r.i): (r.n, r.value) for r in quantiles.closed_quantiles(df, ["k"], "x", s, ps).collect()}
    want = groups(data, ["k"])
    assert got == {(k[0], i): (len(v), v[max(1, int(np.ceil(p * len(v) - 1e-9))) - 1]) for k, v in want.items() for i, p in enumerate(ps)}
    c = {r.k: r for r in quantiles.covered(df, ["k"], "x", s, ps).collect()}
    assert all(c[k[0]].n == len(v) and c[k[0]].n_covered == len(ps) for k, v in want.items())
    # A hot group's summary is a small part of its rows.
    assert c["hot"].n_tuples < 0.02 * c["hot"].n


@pytest.mark.parametrize("eps", [0.3, 0.05, 0.002])
def test_shifted(spark, eps):
    r = np.random.default_rng(3)
    data = []
    for g in range(6):
        for b in range(8):
            n = int(r.choice([5, 39, 40, 41, 400]))
            scale = float(r.choice([1, 1, 1, 2, 0.5, 1.97, 2.4]))
            data += [(f"g{g}", b, float(int(v * scale) + 1), "v", 1) for v in r.gamma(5, 40, n)]
    df = spark.createDataFrame(data, SCHEMA)
    whole, part = groups(data, ["k"]), groups(data, ["k", "b"])
    want = {k for k, v in part.items() if len(v) >= 40 and (np.median(v) >= 2 * np.median(whole[k[:1]]) or 2 * np.median(v) <= np.median(whole[k[:1]]))}
    got = quantiles.shifted_batches(df, "k", "b", "x", quantiles.summarise(df, ["k", "b"], "x", eps))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for key in ("v", "N", "lo0"):
        with pytest.raises(ValueError):
            quantiles.summarise(df, [key], "x")
    s = quantiles.summarise(df, ["k"], "x")
    assert s.count() == 0 and quantiles.medians(s, ["k"]).count() == 0 and quantiles.shifted_batches(df, "k", "b", "x", quantiles.summarise(df, ["k", "b"], "x")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 9)), min_size=1, max_size=80), st.sampled_from([0.0, 0.1, 0.4]))
def test_leaf(values, eps):
    t = pa.table({"k": pa.array([k for k, _ in values], pa.string()), "__v": pa.array([float(v) for _, v in values])})
    out = quantiles._leaf(t, ["k"], eps).to_pylist()
    for key in {k for k, _ in values}:
        v = np.sort([x for k, x in values if k == key])
        mine = sorted((r for r in out if r["k"] == key), key=lambda r: r["v"])
        low = np.cumsum([r["g"] for r in mine])
        high = np.cumsum([r["h"] for r in mine][::-1])[::-1]
        assert low[-1] == len(v) == high[0]
        for r, a, b in zip(mine, low, high, strict=True):
            assert a <= (v <= r["v"]).sum() and b <= (v >= r["v"]).sum()
