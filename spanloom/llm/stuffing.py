"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features, smoothed by the host's rate.

One pass turns every document into page-level features. Weak labels come from another view of the pages: rules on single cues,
which see what a cue looks like and of which no feature holds anything. They are computed for a bounded sample of pages only, pages
between the rules' two bounds stay unlabelled, and the trees that are fitted on the rest decide every page: those that the rules
can't judge, and those that they misjudge. The prediction is drawn towards the rate of the page's host.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import parts
from spanloom.shared import release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bound of the sample of pages, about, that is labelled and that the trees are fitted on.
FIT_PAGES = 40000
TREES, DEPTH, BINS, LEAST_LEAF = 40, 6, 32, 5
#: Share of the features that one tree may use.
USED = 0.4
#: Share of marked cues above and below which a page is labelled.
LABEL_ABOVE, LABEL_BELOW = 0.5, 0.1
#: Weight of the host's rate, and the pages that its prior counts as.
HOST_WEIGHT, HOST_PRIOR = 0.1, 50.0

#: Content: words a cue, letters a word, share of short and of distinct words, shares of the most frequent word and of eight, size
#: when packed, digits, capitals, repeated cues, sentence marks a cue, commas a word, cues that end in a mark, cues that begin as
#: sentences do. Links: links a cue, their share of the text, hosts a link, letters of a host.
FEATURES = [
    "words", "length", "short", "distinct", "top", "top8", "packed", "digits", "capitals", "same", "sentences", "commas", "ends", "starts",
    "links", "linked", "hosts", "host_length",
]

_TIME = re.compile(r"^.*-->.*$", re.M)
_NUMBER = re.compile(r"\n[^\S\n]*[0-9]*[^\S\n]*(?=\n|\Z)")
_MARK = re.compile(r"<[^>\n]*>|\{[^}\n]*\}")
# A link by its form: a scheme, the usual prefix, or a bare domain of labels, one with a letter, and an ending of letters. What a
# missing space joins goes on with a capital ("on.Let"), and abbreviations ("p.m.") have an ending of one letter.
_LINK = re.compile(
    r"https?://([^\s/\"'<>]+)[^\s\"'<>]*|\bwww\.([^\s/\"'<>]+)[^\s\"'<>]*"
    r"|(?<![\w.@-])(?=[\d.-]*[^\W\d_][\w-]*\.)((?:[^\W_](?:[\w-]*[^\W_])?\.)+[a-z]{2,24}|(?:[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?\.)+[A-Z]{2,24})(?![\w@-]|['’]\w|\.\w)(?:[/:?][^\s\"'<>]*)?"
)
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_CAPITAL = re.compile(r"[A-Z]")
_SENTENCE = re.compile(r"[.?!…]+")
_END = re.compile(r"\W\s*\Z")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
# Marks of a cue, for the labels only.
_TAG = re.compile(r"(?<![\w&\"'=])#\w")
_SEPARATOR = re.compile(r"[|;*]")


#: The Western one-byte encoding's letters at the places of control characters, and these.
_AT = {ord(bytes([b]).decode("cp1252", "replace")): b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "replace") != "\ufffd"}


def _decoded(run: re.Match) -> str:
    """A run of characters whose UTF-8 bytes were read in the Western one-byte encoding, maybe more than once, put right."""
    s = run[0]
    for _ in range(3):
        try:
            s = s.translate(_AT).encode("latin-1").decode("utf-8")
        except UnicodeError:
            break
    return s


def cue_texts(text: str) -> list[str]:
    """The text of each cue, without its number and time; what precedes the first time isn't part of one."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    cues = _TIME.split(text if text.isascii() else _FOREIGN.sub(_decoded, text))[1:]
    return [_NUMBER.sub("", c).strip() for c in cues]


def marked(cues: list[str]) -> float:
    """Share of cues with a mark of stuffing: little but a link, several tags or separators, many commas, or repeated words."""
    n = 0
    for cue in cues:
        rest, links = _LINK.subn(" ", cue)
        rest = _MARK.sub(" ", rest)
        words = _WORD.findall(rest.lower())
        n += (
            (links > 0 and len(words) <= 4 * links)
            or len(_TAG.findall(rest)) >= 2
            or len(_SEPARATOR.findall(rest)) >= 2
            or "!!!" in rest
            or rest.count(",") >= 4
            or (len(words) >= 5 and len(set(words)) <= 0.7 * len(words))
        )
    return n / max(len(cues), 1)


def features(cues: list[str]) -> list[float]:
    """FEATURES of a page whose cues hold a word."""
    n, whole = len(cues), "\n".join(cues)
    links = _LINK.findall(whole) if "." in whole else []
    rest = _LINK.sub(" ", whole) if links else whole
    plain = _MARK.sub(" ", rest)
    counts = Counter(_LETTERS.findall(plain.lower()))
    words, letters = max(1, sum(counts.values())), max(1, sum(len(w) * c for w, c in counts.items()))
    top = [c for _, c in counts.most_common(8)] or [0]
    raw = plain.encode("utf-8", "replace")
    size = max(1, len(plain))
    ends = starts = 0
    for cue in cues:
        c = _MARK.sub(" ", cue).strip() if "<" in cue or "{" in cue else cue
        ends += _END.search(c[-64:]) is not None
        starts += c[:1].isupper() or not c[:1].isalnum()
    hosts = {(a or b or c).lower() for a, b, c in links}
    return [
        words / n, letters / words, sum(c for w, c in counts.items() if len(w) <= 3) / words, len(counts) / words, top[0] / words, sum(top) / words, (len(zlib.compress(raw, 1)) - 8) / max(1, len(raw)),
        len(_DIGIT.findall(plain)) / size, len(_CAPITAL.findall(plain)) / letters, 1 - len(set(cues)) / n, len(_SENTENCE.findall(plain)) / n, plain.count(",") / words, ends / n, starts / n,
        len(links) / n, (len(whole) - len(rest)) / max(1, len(whole)), len(hosts) / max(1, len(links)), sum(map(len, hosts)) / max(1, len(hosts)),
    ]


def page_features(documents: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """(doc_id, host, x array<float>, mark) of every document whose cues hold a word, written once as a table.

    ``mark`` is the share of marked cues, null but for about FIT_PAGES pages, chosen by a hash of their id.
    """

    def rows(batches):
        for b in parts(batches):
            cues = [cue_texts(t) for t in b.column(3).to_pylist()]
            keep = [i for i, c in enumerate(cues) if any(map(_WORD.search, c))]
            ids, drawn = pa.array(keep, pa.int64()), b.column(2).to_pylist()
            marks = [marked(cues[i]) if drawn[i] else None for i in keep]
            x = [features(cues[i]) for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(ids), b.column(1).take(ids), pa.array(x, pa.list_(pa.float32())), pa.array(marks, pa.float64())], ["doc_id", "host", "x", "mark"])

    rate = min(1.0, FIT_PAGES / max(1, documents.count()))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << 30)) < int(rate * (1 << 30))
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), drawn.alias("drawn"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    return written(docs.mapInArrow(rows, "doc_id long, host string, x array<float>, mark double"), "pages")


def _tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple:
    """A decision tree of nested (feature, threshold, below, above), leaves the weighted share of label 1."""
    share = float((w * y).sum() / max(w.sum(), 1e-12))
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
        return (share,)
    best, choice = 1e-9, None
    whole = w.sum() * share * (1 - share)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        b = np.searchsorted(c, x[:, j], side="left")
        n, p = np.bincount(b, w, len(c) + 1), np.bincount(b, w * y, len(c) + 1)
        rows = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
        n1, p1 = np.cumsum(n)[:-1], np.cumsum(p)[:-1]
        n2, p2 = n.sum() - n1, p.sum() - p1
        gain = whole - (p1 - p1**2 / np.maximum(n1, 1e-12)) - (p2 - p2**2 / np.maximum(n2, 1e-12))
        gain[(rows < LEAST_LEAF) | (len(y) - rows < LEAST_LEAF)] = -1
        if gain.max() > best:
            # Cuts that part the sample alike lie between the same two values; the middle one leaves room on both sides.
            alike = np.flatnonzero(gain >= gain.max() - 1e-12)
            best, choice = gain.max(), (j, float(c[alike[len(alike) // 2]]))
    if choice is None:
        return (share,)
    j, t = choice
    low = x[:, j] <= t
    return j, t, _tree(x[low], y[low], w[low], cuts, depth - 1), _tree(x[~low], y[~low], w[~low], cuts, depth - 1)


def bagged_trees(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[tuple]:
    """Trees on bootstrap samples, each with a random part of the features; the rarer label's weight lies half-way to balance."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # Half-way points between the labels' ranges matter more than quantiles where one label is rare.
    cuts = [np.unique(np.r_[c, np.linspace(x[:, j].min(), x[:, j].max(), BINS + 1)[1:-1]]) for j, c in enumerate(cuts)]
    balance = np.sqrt(np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)))
    trees = []
    for _ in range(TREES):
        use = set(rng.permutation(x.shape[1])[: max(1, round(USED * x.shape[1]))].tolist())
        i = rng.integers(0, len(y), len(y))
        trees.append(_tree(x[i], y[i], balance[i], [c if j in use else c[:0] for j, c in enumerate(cuts)], DEPTH))
    return trees


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    def walk(node, rows, out):
        if len(node) == 1:
            out[rows] += node[0]
            return
        low = x[rows, node[0]] <= node[1]
        walk(node[2], rows[low], out)
        walk(node[3], rows[~low], out)

    out = np.zeros(len(x))
    for t in trees:
        walk(t, np.arange(len(x)), out)
    return out / max(len(trees), 1)


def scores(documents: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", seed: int = 3) -> DataFrame:
    """(doc_id, host, page_score, host_rate, score): of every document whose cues hold a word; a score above 0.5 means stuffed.

    The fit uses the labelled ones of about FIT_PAGES pages, chosen by a hash of their id. A null host is a host of
    its own. Null texts and texts without cues, or without words in them, get no row; repeated documents one each; an empty table none. Where all labels
    agree, every page gets that label's score, and 0 where there are none. Other columns don't matter.
    """
    pages = page_features(documents, text, key, host)
    spark = pages.sparkSession
    label = F.when(F.col("mark") > LABEL_ABOVE, 1).when(F.col("mark") < LABEL_BELOW, 0)
    # Bounded: about FIT_PAGES rows.
    sample = pages.where("mark IS NOT NULL").select("doc_id", "x", label.alias("y")).where("y IS NOT NULL").toPandas().sort_values("doc_id")
    if len(sample):
        trees = bagged_trees(np.array(sample.x.tolist(), np.float32), sample.y.to_numpy(np.float64), seed)
    else:
        trees = [(0.0,)]
    model = spark.sparkContext.broadcast(trees)

    def score(batches):
        for b in batches:
            c = b.column(2)
            v = c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()].reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(predict(model.value, v))], ["doc_id", "host", "page_score"])

    scored = written(pages.select("doc_id", "host", "x").mapInArrow(score, "doc_id long, host string, page_score double"), "scores")
    release(pages)
    whole = scored.agg(F.coalesce(F.avg((F.col("page_score") > 0.5).cast("double")), F.lit(0.0))).first()[0]
    hosts = scored.groupBy("host").agg(((F.sum((F.col("page_score") > 0.5).cast("double")) + HOST_PRIOR * whole) / (F.count("*") + HOST_PRIOR)).alias("host_rate"))
    joined = scored.alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host")))
    smooth = F.col("page_score") * (1 - HOST_WEIGHT) + F.col("host_rate") * HOST_WEIGHT
    return joined.select("doc_id", "s.host", "page_score", "host_rate", smooth.alias("score"))


def stuffed_pages(documents: DataFrame, **options) -> DataFrame:
    """(doc_id) of the pages whose smoothed score is above 0.5."""
    return scores(documents, **options).where("score > 0.5").select("doc_id")
