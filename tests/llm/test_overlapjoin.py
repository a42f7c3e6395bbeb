"""Similar sets against brute force."""

import random

import pytest

from spanloom.llm import overlapjoin

SCHEMA = "ds_idx int, contig string, tile long, sid string, n int, tok int"


def brute(rows, t):
    sets = {}
    for d, c, x, *_ in rows:
        if d is not None and x is not None:
            sets.setdefault(d, set()).add((c, x))
    ids = sorted(sets)
    return sets, {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def make(seed, sets, universe, largest):
    r = random.Random(seed)
    out, kept = [], []
    for i in range(sets):
        if kept and r.random() < 0.6:
            s = set(r.choice(kept))
            for _ in range(r.randrange(0, max(2, len(s) // 4))):
                s.discard(r.choice(sorted(s))) if len(s) > 1 and r.random() < 0.5 else s.add(r.randrange(universe))
        else:
            s = {r.randrange(universe) for _ in range(r.randrange(1, largest))}
        kept.append(s)
        out += [(i, "c" if x % 2 else "d", x, "s", 1, 2) for x in s]
    out += out[:30]
    return out + [(None, "c", 1, "s", 1, 2), (999, "c", None, "s", 1, 2)]


@pytest.mark.parametrize("threshold,small", [(0.7, 6), (0.5, 4), (0.5, 1), (0.5, 2), (0.5, 3), (0.7, 1), (0.9, 8), (1.0, 6)])
@pytest.mark.parametrize("sets,universe,largest", [(60, 12, 8), (60, 60, 40)])
def test_brute_force(spark, threshold, small, sets, universe, largest):
    rows = make(sets + universe, sets, universe, largest)
    # A token that every set holds, and a set that holds very many.
    rows += [(i, "hot", 1, "s", 1, 2) for i in range(sets)] + [(500, "c", x, "s", 1, 2) for x in range(3000)] + [(501, "c", x, "s", 1, 2) for x in range(2900)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("ds_idx", "contig", "tile", "sid", "n", "tok")
    # Rows without a tile have no token.
    sets_, want = brute(rows, threshold)
    pairs, members = overlapjoin.similar_sets(df, "ds_idx", ["contig", "tile"], threshold, small)
    got = [tuple(r) for r in overlapjoin.expanded(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    m = {r.sid: r.class_id for r in members.collect()}
    assert m == {d: min(x for x in sets_ if sets_[x] == sets_[d]) for d in sets_}
    count = {r.sid: r.n_links for r in overlapjoin.links(pairs, members).collect()}
    assert count == {d: sum(d in p for p in want) for d in sets_}


@pytest.mark.parametrize("small", range(1, 7))
def test_bounds_of_small(spark, small):
    """Pairs right at the threshold, on either side of ``small``."""
    sets = {1: "xy", 2: "xyzw", 3: "k", 4: "kl", 5: "abcde", 6: "abcdefghij", 7: "mno", 8: "mnopqr"}
    df = spark.createDataFrame([(i, c, ord(c), "s", 1, 2) for i, s in sets.items() for c in s], SCHEMA)
    pairs, members = overlapjoin.similar_sets(df, "ds_idx", ["tile"], 0.5, small)
    assert {tuple(r) for r in overlapjoin.expanded(pairs, members).collect()} == {(1, 2), (3, 4), (5, 6), (7, 8)}


def test_tokens_of_parts(spark):
    """A null part makes no token, and parts that read alike when joined stay apart."""
    rows = [(1, "c", None), (2, "c", None), (3, "p:q", "r"), (4, "p", "q:r"), (5, None, "c"), (6, "", "1:a"), (7, "1:", "a"), (8, "p", "q:r")]
    df = spark.createDataFrame(rows, "d int, x string, y string")
    pairs, members = overlapjoin.similar_sets(df, "d", ["x", "y"], 0.5)
    assert {tuple(r) for r in overlapjoin.expanded(pairs, members).collect()} == {(4, 8)}
    assert {r.sid for r in members.collect()} == {3, 4, 6, 7, 8}


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr(overlapjoin, "CHUNK", 7)
    rows = make(3, 40, 60, 40)
    _, want = brute(rows, 0.6)
    pairs, members = overlapjoin.similar_sets(spark.createDataFrame(rows, SCHEMA), "ds_idx", ["contig", "tile"], 0.6, 3)
    assert {tuple(r) for r in overlapjoin.expanded(pairs, members).collect()} == want


def test_empty_and_copies(spark):
    pairs, members = overlapjoin.similar_sets(spark.createDataFrame([], SCHEMA), "ds_idx", ["contig", "tile"])
    assert pairs.count() == 0 and members.count() == 0
    df = spark.createDataFrame([(i, "c", x, "s", 1, 2) for i in range(40) for x in range(9)], SCHEMA)
    pairs, members = overlapjoin.similar_sets(df, "ds_idx", ["contig", "tile"])
    assert pairs.count() == 0 and members.where("class_id = 0").count() == 40
    assert overlapjoin.expanded(pairs, members).count() == 40 * 39 // 2
    with pytest.raises(ValueError):
        overlapjoin.similar_sets(df, "ds_idx", ["tile"], 0.2)
    with pytest.raises(ValueError):
        overlapjoin.similar_sets(df, "ds_idx", ["tile"], 0.7, 0)
