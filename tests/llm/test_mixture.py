"""Mixtures: sizes against the tokenizer, shares against their targets, caps."""

import base64

import numpy as np
import pytest
import tiktoken

from spanloom.llm import mixture

DOCS = "doc_id long, text string, source string, lang string, title_key string, n_tokens int, copies int"
TARGETS = "source string, weight double, max_repeats int, rate int"


def make(seed=1, n=4000):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        s = str(r.choice(["big", "mid", "small", "other"], p=[0.6, 0.3, 0.05, 0.05]))
        out.append((i, "word " * int(r.integers(1, 40)), s, str(r.choice(["en", "EN", "fr", "?", "de"])), f"t{r.integers(0, 40)}", 1, 2))
    return out + [(n + 1, None, "big", None, None, 1, 2), (n + 2, "", "mid", "en", None, 1, 2), (n + 3, "x " * 50, None, "en", "t1", 1, 2)]


def test_sizes(spark):
    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Don't stop.\n\n1\n00:00 --> 00:01\nÜber 12 <|endoftext|>", "", None, "a" * 5000, "line of words\n" * 40000, "word " * 200000, " " * 5000]
    df = spark.createDataFrame([(i, t, "s", "en", "t", 1, 2) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_tokens for r in mixture.token_sizes(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (sum(len(enc.encode_ordinary(p)) for p in mixture._parts(t)) if t else 0)
        assert t is None or "".join(mixture._parts(t)) == t
    assert got[4] == len(enc.encode_ordinary(texts[4]))


def test_shares(spark):
    docs = make()
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 0.2, 1, 0), ("mid", 0.5, 2, 0), ("small", 0.25, 3, 0), ("gone", 0.05, 9, 0), (None, 0.1, 1, 0)], TARGETS)
    sizes = mixture.token_sizes(df)
    sources, rates = mixture.plan(sizes, targets)
    plan = {r.source: r for r in sources.collect()}
    assert {s: r.reachable for s, r in plan.items()} == {"big": True, "mid": True, "small": False, "gone": False}
    mixed = mixture.chosen(sizes, rates)
    rows = mixed.collect()
    limit = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.copies <= limit[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    used = {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in limit}
    total = sizes.agg({"n_tokens": "sum"}).head()[0]
    assert used["small"] == 3 * plan["small"].available
    for s, w in (("big", 0.2), ("mid", 0.5)):
        assert abs(used[s] / total - w) < 0.03
    report = {r.source: r for r in mixture.shares(mixed, sources).collect()}
    assert abs(sum(r.share for r in report.values()) - 1) < 1e-9 and report["gone"].tokens == 0
    assert [tuple(r) for r in mixture.chosen(sizes, rates).orderBy("doc_id").collect()] == [tuple(r) for r in mixed.orderBy("doc_id").collect()]


def test_verdict_comes_from_the_fit(spark, monkeypatch):
    """Without the fit nothing tells which source reaches its share."""
    sizes = mixture.token_sizes(spark.createDataFrame(make(), DOCS))
    targets = spark.createDataFrame([("big", 0.2, 1, 0), ("mid", 0.5, 2, 0), ("small", 0.25, 3, 0)], TARGETS)
    assert {r.source for r in mixture.plan(sizes, targets)[0].where("reachable").collect()} == {"big", "mid"}
    monkeypatch.setattr(mixture, "rake", lambda size, *_: np.ones(len(size)))
    assert {r.source for r in mixture.plan(sizes, targets)[0].where("reachable").collect()} == {"big"}


def test_exact_reach(spark):
    """A target that the cap just allows is reached."""
    docs = spark.createDataFrame([(1, "a b c", "x", "en", "t", 1, 2), (2, "a b c", "y", "en", "t", 1, 2)], DOCS)
    targets = spark.createDataFrame([("x", 0.5, 1, 0), ("y", 1.0, 2, 0)], TARGETS)
    assert [r.reachable for r in mixture.plan(mixture.token_sizes(docs), targets)[0].orderBy("source").collect()] == [True, True]


def test_topics_follow_the_text(spark):
    """Documents of one vocabulary share a topic, whatever their work, source or order."""
    r = np.random.default_rng(3)
    kinds = [["river", "stone", "bridge", "water", "boat"], ["engine", "wheel", "road", "driver", "fuel"], ["bread", "salt", "oven", "flour", "cake"]]
    docs = [(i, " ".join(r.choice(kinds[i % 3], 30)), "s", "en", f"t{i}", 1, 2) for i in range(240)]
    got = {x.doc_id: x.topic for x in mixture.token_sizes(spark.createDataFrame(docs, DOCS).repartition(5)).collect()}
    of = [{got[i] for i in range(k, 240, 3)} for k in range(3)]
    assert not of[0] & of[1] and not of[0] & of[2] and not of[1] & of[2]
    again = {x.doc_id: x.topic for x in mixture.token_sizes(spark.createDataFrame(docs[::-1], DOCS).repartition(2)).collect()}
    assert got == again


def test_promises(spark):
    sizes = mixture.token_sizes(spark.createDataFrame(make(), DOCS))
    sources, rates = mixture.plan(sizes, spark.createDataFrame([("big", 0.2, 1, 0), ("mid", 0.5, 2, 0), ("small", 0.25, 3, 0), ("gone", 0.05, 9, 0)], TARGETS))
    mixed = mixture.chosen(sizes, rates)
    kept = {r.source: (r.n_over, r.n_repeated, r.in_bound) for r in mixture.kept_promises(mixed, sources, rates, sizes).collect()}
    assert kept == dict.fromkeys(["big", "mid", "small", "gone"], (0, 0, True))
    broken = mixed.selectExpr("doc_id", "source", "lang", "n_tokens", "copies + 1 copies")
    kept = {r.source: (r.n_over > 0, r.in_bound) for r in mixture.kept_promises(broken.unionByName(mixed), sources, rates, sizes).collect()}
    assert kept["big"] == (True, False) and kept["small"] == (True, False)


def test_rake_keeps_margins():
    r = np.random.default_rng(0)
    source, lang, topic = (r.integers(0, k, 200) for k in (4, 5, 6))
    size = r.integers(1, 100, 200).astype(float)
    cap = np.array([1.0, 3.0, 3.0, 4.0])
    target = np.array([0.1, 0.3, 0.3, 0.3]) * size.sum()
    rate = mixture.rake(size, [source, lang, topic], target, cap)
    assert np.allclose(np.bincount(source, size * rate), target) and (rate <= cap[source] + 1e-9).all() and (rate >= 0).all()
    have, want = np.bincount(lang, size * rate), np.bincount(lang, size) / size.sum() * target.sum()
    assert np.abs(have / want - 1).max() < 0.05


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None, 1, 2)]])
def test_empty(spark, docs):
    sizes = mixture.token_sizes(spark.createDataFrame(docs, DOCS))
    sources, rates = mixture.plan(sizes, spark.createDataFrame([("a", 0.5, 2, 0)], TARGETS))
    assert mixture.chosen(sizes, rates).count() == 0
    assert mixture.shares(mixture.chosen(sizes, rates), sources).head().share == 0
    sources, rates = mixture.plan(sizes, spark.createDataFrame([], TARGETS))
    assert sources.count() == 0 and rates.count() == 0


def test_fit_covers_all_documents(spark):
    """Space and topics come from every document, of which there are more than the 4,000 that a sample once had: directions hold as
    much as the best of all rows do, and each centre is the mean of all documents of its topic."""
    r = np.random.default_rng(4)
    words = [[f"{k}{a}{b}" for a in "bdfgk" for b in "aeiou"] for k in ("zu", "mi", "ro", "pa", "le", "ni", "to")]
    df = spark.createDataFrame([(i, " ".join(r.choice(words[i % 7], 30)), "s", "en", "t", 1, 2) for i in range(6000)], DOCS)
    tokens = mixture._tokenized(df, mixture.TOKENIZER, "text", "doc_id", "source", "lang")
    freq, n = mixture._document_frequencies(tokens)
    idf = np.log((n + 1) / (freq + 1)).astype(np.float32) + np.float32(0.01)
    x = mixture._vectors(*zip(*((t.terms, t.tf) for t in tokens.orderBy("doc_id").collect()), strict=True), idf).astype(np.float64)
    space = mixture.fit_space(tokens, idf)
    best = np.sort(np.linalg.eigvalsh(x.T @ x))[::-1][:7]
    assert np.allclose(np.sort(((x @ space) ** 2).sum(0))[::-1][:7], best, rtol=1e-3)
    z = mixture._unit(x @ space).astype("<f4")
    centres = mixture.fit_topics(spark.createDataFrame([(v.tobytes(),) for v in z], "z binary"))
    own = (z @ centres.T).argmax(1)
    assert all((mixture._unit(z[own == k].sum(0)[None]) @ centres[k])[0] > 0.999 for k in set(own))
    assert all(len({*own[i::7]} & {*own[(i + 1) % 7 :: 7]}) == 0 for i in range(7))
