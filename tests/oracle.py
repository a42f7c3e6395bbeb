"""Compare registered queries with their SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def differences(spark, f, sql: str, sf_dir: str = SF) -> tuple[int, str]:
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    c = connect(sf_dir)
    c.execute(sql)
    got = [x[0] for x in c.description]
    want_names = sorted(got)
    if names != want_names:
        return -1, f"columns {names} and {want_names}"
    order = [got.index(n) for n in names]
    want = Counter(tuple(_cell(r[i]) for i in order) for r in c.fetchall())
    have = Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())
    more, less = have - want, want - have
    return sum(have.values()), f"too many: {list(more.items())[:3]} ({sum(more.values())}); missing: {list(less.items())[:3]} ({sum(less.values())})" if more or less else ""
