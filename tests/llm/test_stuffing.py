"""Stuffed pages: features, trees and held-out accuracy on pages written here."""

import random

import numpy as np
import pytest

from spanloom.llm import stuffing

DOCS = "doc_id long, text string, source string, x string, score int"


def page(r, spam, cues):
    out = []
    for k in range(cues):
        kind = r.choice(["tags", "links", "list", "run"]) if r.random() < spam else "speech"
        words = [r.choice(["shoes", "cheap", "buy", "lamp", "deal", "best"]) for _ in range(8)]
        line = {
            "tags": " ".join("#" + w for w in words[:4]),
            "links": "https://" + words[0] + ".example/" + words[1],
            "list": ", ".join(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)),
            "run": " ".join(words + words),
            "speech": r.choice(["Where did you put the lamp?", "Bread, milk, eggs and two crowns.", "Come in, come in.", "[door slams]", "♪ la la la ♪", "I told you that\nnobody saw it."]),
        }[kind]
        out.append(f"{k + 1}\n00:00:{k % 60:02},000 --> 00:00:{k % 60:02},900\n{line}\n")
    return "\n".join(out)


def test_held_out(spark):
    r = random.Random(1)
    docs = []
    for i in range(500):
        spam = r.choice([0, 0, 0.05, 0.1, 0.8, 0.95]) if i % 4 == 0 else 0.03
        docs.append((i, page(r, spam, r.randrange(12, 40)), r.choice(["a", "b", None]), "x", 1, spam))
    df = spark.createDataFrame([d[:5] for d in docs], DOCS)
    got = {x.doc_id for x in stuffing.stuffed_pages(df).collect()}
    assert got == {d[0] for d in docs if d[5] > 0.5}
    s = stuffing.scores(df).collect()
    assert len(s) == len(docs) and all(0 <= x.score <= 1 and 0 <= x.host_rate <= 1 for x in s)


def held_out_pages(n=900, seed=5):
    """Pages whose stuffed cues a rule on single cues marks all (``tags``, ``run``) or in part (``plain``, ``ended``)."""
    r = random.Random(seed)
    pool = ["shoes", "cheap", "buy", "lamp", "deal", "best", "sale", "offer", "outlet", "order", "price", "discount"]
    out = []
    for i in range(n):
        host = r.choice(["clean", "mixed", "spam"])
        spam = r.random() < {"clean": 0.0, "mixed": 0.1, "spam": 0.6}[host]
        kind, cues = r.choice(["tags", "run", "plain", "ended"]), []
        for k in range(r.randrange(12, 40)):
            if spam and r.random() < 0.9:
                w = r.sample(pool, 7)
                as_ = r.choice(["tags", "run"]) if r.random() < 0.3 else kind
                v = {"tags": " ".join("#" + x for x in w[:4]), "run": " ".join(w[:3] * 3), "plain": " ".join(w), "ended": " ".join(w[:5]) + "."}[as_]
            else:
                v = r.choice(["Where did you put the lamp?", "I told you that nobody saw it.", "Come in.", "[door slams]", "We waited for three days, and then it rained.", "She said it was on the hill."])
            cues.append(f"{k + 1}\n00:00:{k % 60:02},000 --> 00:00:{k % 60:02},900\n{v}\n")
        out.append((i, "\n".join(cues), host, "x", 1, spam))
    return out


def test_trees_beat_the_rule(spark):
    """On pages that no tree was fitted on, the rule alone does worse than the trees with smoothing."""
    docs = held_out_pages()
    x = {d[0]: stuffing.features(stuffing.cue_texts(d[1])) for d in docs}
    mark = {d[0]: stuffing.marked(stuffing.cue_texts(d[1])) for d in docs}
    fit = [d[0] for d in docs if d[0] % 2 and not stuffing.LABEL_BELOW <= mark[d[0]] <= stuffing.LABEL_ABOVE]
    trees = stuffing.bagged_trees(np.array([x[i] for i in fit], np.float32), np.array([mark[i] > stuffing.LABEL_ABOVE for i in fit], float))
    held = [d for d in docs if d[0] % 2 == 0]
    p = stuffing.predict(trees, np.array([x[d[0]] for d in held], np.float32))
    hosts = {h: np.mean([q > 0.5 for q, d in zip(p, held, strict=True) if d[2] == h]) for h in ("clean", "mixed", "spam")}
    score = [0.9 * q + 0.1 * hosts[d[2]] for q, d in zip(p, held, strict=True)]
    wrong_rule = sum((mark[d[0]] > stuffing.LABEL_ABOVE) != d[5] for d in held)
    wrong_trees = sum((s > 0.5) != d[5] for s, d in zip(score, held, strict=True))
    assert wrong_rule > 30 and wrong_trees < 0.5 * wrong_rule


def test_features_hold_no_label():
    """No mark of the labels changes a feature: tags, separators and repeated words within a cue are seen by the rule only."""
    a = ["one two three four five six.", "seven eight nine ten eleven twelve."]
    b = ["#one #two #three #four #five #six.", "seven | eight | nine | ten | eleven | twelve."]
    assert stuffing.marked(a) == 0 and stuffing.marked(b) == 1
    near = [i for i, n in enumerate(stuffing.FEATURES) if n not in ("packed", "starts")]
    assert [stuffing.features(a)[i] for i in near] == [stuffing.features(b)[i] for i in near]


def test_host_decides_between():
    """The host's rate turns pages whose own score is near the bound, and only those."""
    w = stuffing.HOST_WEIGHT
    assert 0.49 * (1 - w) + 0.9 * w > 0.5 > 0.52 * (1 - w) + 0.1 * w and 0.8 * (1 - w) > 0.5


def test_trees_generalise():
    r = np.random.default_rng(2)
    x = r.random((2000, 4)).astype(np.float32)
    y = ((x[:, 1] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    trees = stuffing.bagged_trees(x[:1000], y[:1000])
    assert ((stuffing.predict(trees, x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


@pytest.mark.parametrize("docs", [[], [(1, None, "a", "x", 1), (2, "", "a", "x", 1), (3, "no cues here", None, "x", 1)], [(1, "1\n0 --> 1\nHello there.\n", None, "x", 1)] * 3])
def test_few(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    assert stuffing.stuffed_pages(df).count() == 0
    assert stuffing.scores(df).count() == sum("-->" in (d[1] or "") for d in docs)


def test_very_long():
    text = "1\n00:00 --> 00:01\n" + "word " * 300000 + "\n" + "\n" * 100000
    assert stuffing.features(stuffing.cue_texts(text))[stuffing.FEATURES.index("distinct")] < 0.01


def test_no_words(spark):
    df = spark.createDataFrame([(1, "1\n00:00 --> 00:01\n\n", "a", "x", 1), (2, "1\n00:00 --> 00:01\n...\n", "a", "x", 1)], DOCS)
    assert stuffing.scores(df).count() == 0


@pytest.mark.parametrize("text", ["♪ Après la pluie ♪", "Das Türschloß", "“Où ça?”"])
@pytest.mark.parametrize("times", [1, 2])
def test_wrong_encodings(text, times):
    wrong = text
    for _ in range(times):
        # The one-byte encoding as it is used: control characters where it has no letter.
        wrong = "".join(bytes([b]).decode("cp1252") if bytes([b]).decode("cp1252", "ignore") else chr(b) for b in wrong.encode())
    assert wrong != text and stuffing.cue_texts(f"1\n00:00 --> 00:01\n{wrong}\n") == [text]
    assert stuffing.cue_texts(f"1\n00:00 --> 00:01\n{text}\n") == [text]


def links(line):
    return stuffing.features([line])[stuffing.FEATURES.index("links")]


@pytest.mark.parametrize("end", ["io", "de", "ru", "tv", "shop", "co.uk", "com"])
def test_bare_domains(end):
    for line in (f"lamp.{end}", f"cheap-lamp.{end}/deal?x=1 shoes24.{end}", f"LAMP.{end.upper()}", f"(best.{end})", f"https://a.{end}/x", f"www.b.{end}"):
        assert links(line) >= 1, line


@pytest.mark.parametrize("line", ["Come on.Let's go.", "wait...what", "At 5 p.m.", "The U.S.A. won", "1.milk 2.bread", "It's 3.5mm", "on.let's go", "a@b.c d"])
def test_no_domain(line):
    assert links(line) == 0
