"""Leaked test items against brute force over words."""

import numpy as np
import pytest

from spanloom.llm import leakage

DOCS = "doc_id long, text string, words string, seg int"
ITEMS = "item_id long, text string, extra int"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "tor", "vel", "wix") for b in ("ban", "der", "fol", "gim", "hap", "jur", "kel", "lop", "mus", "nit")]


def brute(docs, items, n=12):
    grams = {}
    for i, t, *_ in items:
        w = leakage.item_words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = leakage.spoken_words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def make(n_docs=300, seed=4):
    r = np.random.default_rng(seed)
    text = lambda n: [WORDS[i] for i in r.zipf(1.3, n) % len(WORDS)]
    items = [(i, " ".join(text(int(r.integers(5, 70)))), 1) for i in range(30)] + [(98, None, 1), (99, "", 1)]
    docs = []
    for d in range(n_docs):
        w = text(int(r.integers(0, 90)))
        if d % 3 == 0:
            source = items[int(r.integers(0, 30))][1].split()
            k = int(r.integers(6, 25))
            at = int(r.integers(0, max(1, len(source) - k)))
            place = int(r.integers(0, len(w) + 1))
            w[place:place] = source[at : at + k]
        lines = [" ".join(w[k : k + 7]) for k in range(0, len(w), 7)]
        cues = [f"{k + 1}\n00:00:0{k % 9},000 --> 00:00:0{k % 9},900 x:1\n<i>{line.upper() if k % 2 else line}</i>\n" for k, line in enumerate(lines)]
        docs.append((d, "\r\n".join("\n".join(cues).split("\n")) if d % 5 == 0 else "\n".join(cues), "w", 1))
    return docs, items


def test_brute_force(spark):
    docs, items = make()
    docs += [(900, None, "w", 1), (901, "", "w", 1), (902, "-->", "w", 1), (903, docs[0][1], "w", 1), (None, docs[0][1], "w", 1)]
    # A very long text with an item at a segment's border.
    long = [WORDS[i % 7] + str(i % 11) for i in range(3 * leakage.SEGMENT)]
    for at in (leakage.SEGMENT - 5, 2 * leakage.SEGMENT - 11, 3 * leakage.SEGMENT - 12):
        long[at : at + 12] = [w for _, t, _ in items if t and len(t.split()) > 40 for w in t.split()][3:15]
    docs.append((904, " ".join(long), "w", 1))
    df, it = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    want = brute([d for d in docs if d[0] is not None], items)
    assert len(want) > 40 and any(d == 904 for d, _ in want)
    for cosine in (-1.1, leakage.COSINE):
        rows = [tuple(r)[:2] for r in leakage.leaks(df, it, cosine).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_blocks_of_items(spark, monkeypatch):
    """Items in several blocks, long lists met a part at a time, repeated ids: the same rows."""
    docs, items = make(120)
    items += [(3, items[5][1], 1)]
    df, it = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    near = {(r.doc_id, r.item_id, r.lcs, r.answered) for r in leakage.paraphrases(df, it).collect()}
    monkeypatch.setattr(leakage, "ITEM_WORDS", 300)
    monkeypatch.setattr(leakage, "MEETINGS", 50)
    monkeypatch.setattr(leakage, "SLICE", 200)
    assert {tuple(r)[:2] for r in leakage.leaks(df, it).collect()} == want
    assert {(r.doc_id, r.item_id, r.lcs, r.answered) for r in leakage.paraphrases(df, it).collect()} == near


def changed(w, how, r):
    """A paraphrase of words: a share of them replaced, as many inserted, or clauses in another order."""
    if how == "replaced":
        return [f"new{r.integers(0, 50)}" if r.random() < 0.25 else x for x in w]
    if how == "inserted":
        return [y for x in w for y in ([x, f"new{r.integers(0, 50)}"] if r.random() < 0.25 else [x])]
    clauses = [w[k : k + 12] for k in range(0, len(w), 12)]
    return [x for i in r.permutation(len(clauses)) for x in clauses[i]]


@pytest.mark.parametrize("how", ["replaced", "inserted", "reordered"])
def test_paraphrase_recall(spark, how):
    """Of items that stand reworded in a document at least nine tenths are found."""
    r = np.random.default_rng(11)
    items = [(i, " ".join(WORDS[k] + str(r.integers(0, 6)) for k in r.zipf(1.3, int(r.integers(24, 70))) % len(WORDS)), 1) for i in range(60)]
    docs = []
    for d in range(240):
        w = [WORDS[k] for k in r.zipf(1.3, int(r.integers(20, 90))) % len(WORDS)]
        at = int(r.integers(0, len(w)))
        docs.append((d, " ".join(w[:at] + changed(items[d % 60][1].split(), how, r) + w[at:]), "w", 1))
    got = {(x.doc_id, x.item_id) for x in leakage.paraphrases(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert sum((d, d % 60) in got for d in range(240)) >= 0.9 * 240


def test_cost_of_more_items():
    """Meetings of a corpus with test passages hardly grow where items grow tenfold that the corpus doesn't hold."""
    r = np.random.default_rng(2)
    hashed = leakage._hasher()
    text = lambda n: [WORDS[k] + str(r.integers(0, 4)) for k in r.zipf(1.3, n) % len(WORDS)]
    items = [(i, hashed(text(40)), hashed([])) for i in range(1000)]
    corpus = [hashed(text(60)) for k in range(200)]
    corpus = [np.r_[c, items[k % 100][1]] for k, c in enumerate(corpus)]
    flat, offsets = np.concatenate(corpus), np.r_[0, np.cumsum([len(c) for c in corpus])]
    met = []
    for n in (100, 1000):
        vocabulary = leakage._vocabulary(items[:n], leakage.SHINGLE)
        tables = leakage._search_tables(items[:n], np.ones((leakage.TERMS, 2), np.float32), vocabulary, np.ones(len(vocabulary)), lambda n: np.where(n >= 12, 12, 19), leakage.SHINGLE, leakage.HITS)
        met.append(len(leakage._met(flat, offsets, tables)[0]))
    assert met[0] > 200 and met[1] < 1.5 * met[0]

@pytest.mark.parametrize("copies", [1, 5])
def test_one_text(spark, copies):
    """A corpus of one document or of copies only, where every term is in every segment."""
    docs, items = make(1)
    text = " ".join(t for _, t, _ in items[:3])
    docs = [(d, text, "w", 1) for d in range(copies)]
    want = brute(docs, items)
    assert len(want) >= copies
    rows = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and all(r.cosine > leakage.COSINE for r in rows)


def test_no_leak_depends_on_the_cosine(spark):
    docs, items = make()
    df, it = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    # Beyond any cosine only the shared words lead to a pair; below all, both ways do, and it counts once.
    none, usual, every = ({(r.doc_id, r.item_id, r.n_runs) for r in leakage.leaks(df, it, c).collect()} for c in (1.1, leakage.COSINE, -1.1))
    assert none == usual == every and {x[:2] for x in none} == brute(docs, items)


def test_empty(spark):
    docs, items = make(20)
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_docs, some_items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for f in (leakage.leaks, leakage.paraphrases):
        assert f(none_docs, some_items).count() == 0 and f(some_docs, none_items).count() == 0


def test_recall_on_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    want = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == want
    near = {(r.doc_id, r.item_id) for r in leakage.paraphrases(docs, items).collect()}
    # A run of 12 words is two thirds of a passage of 18.
    assert want <= near


def _common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        above = best[:]
        for j, y in enumerate(b):
            best[j + 1] = above[j] + 1 if x == y else max(above[j + 1], best[j])
    return best[-1]


def brute_paraphrases(docs, items, least=0.6):
    """The best share of every document and item, over all pairs of passages."""
    parts = {i: [t.tolist() for t in leakage._item_passages([(i, np.array(w))])[0]] for i, t, *_ in items if (w := leakage.item_words(t or ""))}
    best = {}
    for d, t, *_ in docs:
        w = leakage.spoken_words(t or "")
        for k in range(0, len(w), leakage.BLOCK):
            for i, some in parts.items():
                share = max(_common(w[k : k + leakage.LENGTH], x) / len(x) for x in some)
                if share >= least:
                    best[d, i] = max(share, best.get((d, i), 0))
    return best


def test_paraphrases_brute_force(spark):
    docs, items = make(60)
    # Short items, of which an exact text and one with every third word replaced must be found as well.
    items += [(50, "tin roof", 1), (51, "seven grey boats left the pier", 1)]
    docs += [(900, "seven grey x left the y", "w", 1), (901, "b " * 40 + "tin roof " + "a " * 40, "w", 1), (902, None, "w", 1), (903, "tin", "w", 1)]
    want = brute_paraphrases(docs, items)
    df, it = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    rows = leakage.paraphrases(df, it).collect()
    got = {(r.doc_id, r.item_id): r.lcs for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys() and {(900, 51), (901, 50)} <= got.keys()
    # Of a pair's passages one that holds the answer goes before a longer one.
    assert all(got[k] <= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
    assert any(r.cosine < 0.85 for r in rows)
    assert {(r.doc_id, r.item_id) for r in leakage.paraphrases(df, it, 0.85).collect()} < got.keys()


def test_subsequence():
    a = np.array([[1, 2, 3, 4, -2], [1, 1, 1, 1, 1], [5, 6, 7, -2, -2]])
    b = np.array([[1, 3, 4, 9], [2, 2, 2, -1], [7, 6, 5, -1]])
    assert leakage.lcs(a, b).tolist() == [3, 0, 1]


@pytest.mark.parametrize("text,words", [("1\n00:01 --> 00:02\n<b>It's</b> {x}A_b\n 7 \r\n8 x", ["it", "s", "a", "b", "8", "x"]), ("12\r34\rab", ["ab"]), ("", [])])
def test_words(text, words):
    assert leakage.spoken_words(text) == words
