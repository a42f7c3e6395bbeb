"""Mixtures of sources with target weights, in tokens of a public tokenizer.

Topics are clusters of all texts in a latent space: randomised SVD of TF-IDF over hashed tokens, fitted in passes over them. Token sizes are summed per cell of
source, language and topic. Iterative proportional fitting rakes the cells' token weights to the margins: each source's target
share (as far as its repeats allow), and the languages' and topics' own shares. The calibrated weight of a cell is its documents'
expected number of uses; each document gets its whole part for certain and one more use with the remaining probability, decided by
a hash of its id. Whether a source reaches its share is read off the fit: it does if its raked tokens come up to its target.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import parts
from spanloom.shared import release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern of pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hashed tokens and dimensions of the latent space, and the topics in it.
TERMS, RANK, TOPICS = 2048, 16, 16
#: Extra directions of the random start and rounds of the power iteration.
EXTRA, ROUNDS = 16, 4
#: Parts of one that sums over documents are rounded to: sums of some billion documents' unit vectors fit 64 bits.
SCALE = float(1 << 30)
#: Texts beyond this many characters are tokenized in parts, cut at line ends, so that memory stays bounded.
PART = 1 << 18
ITERATIONS = 50
#: Rounding that a source's raked tokens may fall short of its target by.
SLACK = 1e-9


def _parts(text: str):
    at = 0
    while len(text) - at > PART:
        to = text.rfind("\n", at + 1, at + PART)
        to = at + PART if to < 0 else to
        yield text[at:to]
        at = to
    yield text[at:]


def _tokenized(documents: DataFrame, tokenizer: str, text: str, key: str, source: str, lang: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, terms, tf) of every document, written once: its hashed tokens and how often it has each, as
    bytes of two-byte and of four-byte integers."""

    def count(batches):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # A token's term: a fixed mixing of its number, so that neighbours in the vocabulary fall apart.
        term_of = ((np.arange(max(ranks.values()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TERMS
        for b in parts(batches):
            n, terms, tf = [], [], []
            for t in b.column(3).to_pylist():
                counts, size = None, 0
                for p in _parts(t) if t else ():
                    ids = encoding.encode_ordinary(p)
                    size += len(ids)
                    mine = np.bincount(term_of[ids], minlength=TERMS) if ids else 0
                    counts = mine if counts is None else counts + mine
                at = np.flatnonzero(counts) if size else np.zeros(0, np.int64)
                n.append(size)
                terms.append(at.astype("<i2").tobytes())
                tf.append((counts[at] if size else at).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "source", "lang", "n_tokens", "terms", "tf"])

    code = F.lower(F.trim(F.col(lang)))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.when(code.rlike(r"\A[a-z]{2}\z"), code).otherwise("und").alias("lang"), F.col(text).alias("text"))
    return written(rows.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long, terms binary, tf binary"), "tokens")


def _document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and documents, over all of them: TERMS + 1 numbers come back."""

    def count(batches):
        total = np.zeros(TERMS + 1, np.int64)
        for b in batches:
            total[:TERMS] += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i2"), minlength=TERMS)
            total[TERMS] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    counts = tokens.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1)
    out[counts.term] = counts.n
    return out[:TERMS], int(out[TERMS])


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z))[:, None], 1e-12)


def _vectors(terms: list[bytes], tf: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF of unit length; a document without tokens has a row of zeros."""
    size = np.array([len(t) // 2 for t in terms], np.int64)
    t = np.frombuffer(b"".join(terms), "<i2")
    x = np.zeros((len(terms), TERMS), np.float32)
    x[np.repeat(np.arange(len(terms)), size), t] = (1 + np.log(np.frombuffer(b"".join(tf), "<i4"))) * idf[t]
    return _unit(x)


def _summed(table: DataFrame, part, rows: int, width: int) -> np.ndarray:
    """The sum over all rows of ``table`` of ``part(batch)``, a matrix of rows x width numbers: they come back, and each task hands on
    as many. Tasks' sums are added as whole numbers, so the order in which they come makes no difference."""
    names = [f"c{i}" for i in range(width)]

    def total(batches):
        out = np.zeros((rows, width))
        for b in parts(batches):
            out += part(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *(pa.array(c) for c in np.ascontiguousarray(np.rint(out * SCALE).astype(np.int64).T))], ["at", *names])

    sums = table.mapInArrow(total, "at long, " + ", ".join(f"{c} long" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
    return sums.sort_values("at")[names].to_numpy(np.float64) / SCALE


def fit_space(tokens: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """The TERMS x rank map into the latent space: randomised SVD of the TF-IDF of all documents. A step of the power iteration is a
    pass over them."""
    vectors = tokens.where(F.length("terms") > 0).select("terms", "tf")

    def through(y: np.ndarray) -> np.ndarray:
        y = y.astype(np.float32)

        def part(b):
            x = _vectors(b.column(0).to_pylist(), b.column(1).to_pylist(), idf)
            return x.T @ (x @ y)

        return _summed(vectors, part, TERMS, y.shape[1])

    y = np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA))
    for _ in range(ROUNDS):
        y = np.linalg.qr(through(y))[0]
    _, inner = np.linalg.eigh(y.T @ through(y))
    return (y @ inner[:, ::-1][:, :RANK]).astype(np.float32)


def fit_topics(latent: DataFrame) -> np.ndarray:
    """Topics x rank centres: k-means on the unit sphere over all rows of ``latent`` (z: bytes of a place), each round a pass over
    them. It starts from the means of the fullest of the cells that the places' outstanding coordinate and its sign make."""
    places = lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), "<f4").reshape(b.num_rows, RANK)
    ones = lambda z: np.c_[z, np.ones(len(z), np.float32)]

    def grouped(own, z: np.ndarray, n: int) -> np.ndarray:
        return (own[:, None] == np.arange(n)).astype(np.float32).T @ ones(z)

    def moments(b):
        z = places(b)
        return np.array([*(z.sum(0, dtype=np.float64), (z * z).sum(0, dtype=np.float64)), np.full(RANK, len(z))])

    total, squares, n = _summed(latent, moments, 3, RANK)
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean * mean, 1e-12))

    def outstanding(b):
        z = places(b)
        far = (z - mean) / spread
        at = np.abs(far).argmax(1)
        return grouped(2 * at + (far[np.arange(len(z)), at] > 0), z, 2 * RANK)

    cells = _summed(latent, outstanding, 2 * RANK, RANK + 1)
    cells = cells[np.argsort(-cells[:, RANK], kind="stable")][:TOPICS]
    centres = _unit(cells[cells[:, RANK] > 0, :RANK])
    for _ in range(30):
        near = centres.astype(np.float32)
        sums = _summed(latent, lambda b: grouped((places(b) @ near.T).argmax(1), places(b), len(near)), len(near), RANK + 1)  # noqa: B023
        moved = np.where(sums[:, RANK:] > 0, _unit(sums[:, :RANK]), centres)
        still = np.abs(moved - centres).max() < 1e-6
        centres = moved
        if still:
            break
    return centres.astype(np.float32)


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every document, written once as a table.

    ``lang`` is a two-letter code in lower case, 'und' for anything else, so there are at most 677; ``topic`` the nearest of TOPICS
    clusters in the latent space, -1 for a text without tokens. Counts, space and clusters are those of all documents. A null text
    has 0 tokens.
    """
    tokens = _tokenized(documents, tokenizer, text, key, source, lang)
    df, n = _document_frequencies(tokens)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.01)
    if not df.any():
        return written(tokens.select("doc_id", "source", "lang", F.lit(-1).alias("topic"), "n_tokens"), "sizes")
    space = fit_space(tokens, idf)

    def place(batches):
        for b in parts(batches):
            terms = b.column(4).to_pylist()
            z = _unit(_vectors(terms, b.column(5).to_pylist(), idf) @ space).astype("<f4")
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([v.tobytes() if t else None for t, v in zip(terms, z, strict=True)], pa.binary())], ["doc_id", "source", "lang", "n_tokens", "z"])

    latent = written(tokens.mapInArrow(place, "doc_id long, source string, lang string, n_tokens long, z binary"), "latent")
    release(tokens)
    centres = fit_topics(latent.where("z IS NOT NULL").select("z"))

    def assign(batches):
        for b in batches:
            z = b.column(4).to_pylist()
            some = np.flatnonzero([x is not None for x in z])
            topic = np.full(b.num_rows, -1, np.int32)
            if len(some):
                topic[some] = (np.frombuffer(b"".join(z[i] for i in some), "<f4").reshape(-1, RANK) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(topic), b.column(3)], ["doc_id", "source", "lang", "topic", "n_tokens"])

    sizes = written(latent.mapInArrow(assign, "doc_id long, source string, lang string, topic int, n_tokens long"), "sizes")
    release(latent)
    return sizes


def _filled(size: np.ndarray, rate: np.ndarray, cap: float, target: float) -> np.ndarray:
    """Rates scaled by one factor, none above ``cap``, so that the sizes used sum to ``target``, or all at the cap."""
    if target >= cap * size.sum() or not size.sum():
        return np.full_like(rate, cap)
    rate = np.maximum(rate, 1e-12)
    full = np.zeros(len(rate), bool)
    while True:
        free = ~full
        factor = (target - cap * size[full].sum()) / (size[free] * rate[free]).sum()
        over = free & (rate * factor > cap)
        if not over.any():
            return np.where(full, cap, rate * factor)
        full |= over


def rake(size: np.ndarray, margins: list[np.ndarray], source_target: np.ndarray, cap: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Expected uses of each cell: fit to the sources' targets (``margins[0]`` names each cell's source) and to the shares that
    the other margins have in ``size``, never above ``cap`` of the source. The last step is the sources', so theirs hold; a source
    that can't come up to its target is used to its cap."""
    rate = np.ones(len(size))
    if not len(size):
        return rate
    total = np.minimum(source_target, cap * np.bincount(margins[0], size, minlength=len(cap))).sum()
    wanted = [np.bincount(m, size) / max(size.sum(), 1) * total for m in margins[1:]]
    for _ in range(iterations):
        old = rate.copy()
        for m, w in zip(margins[1:], wanted, strict=True):
            have = np.bincount(m, size * rate, minlength=len(w))
            rate = np.minimum(rate * np.where(have > 0, w / np.maximum(have, 1e-12), 1.0)[m], cap[margins[0]])
        for s in range(len(source_target)):
            mine = margins[0] == s
            if mine.any():
                rate[mine] = _filled(size[mine], rate[mine], cap[s], source_target[s])
        if np.abs(rate - old).max() < 1e-9:
            break
    return rate


def plan(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, rates) of a mixture as large as all documents together.

    sources(source, weight, max_repeats, available, target, raked, reachable): sizes in tokens; ``raked`` are the tokens that the
    fit gives the source, ``reachable`` tells whether they come up to its weight of the total. rates(source, lang, topic, rate): expected uses of each cell's documents.
    A source without documents has 0 available; a null weight counts as 0, a null or negative max_repeats as 0. Documents of
    sources without a target take part in the total only.
    """
    spark = sizes.sparkSession
    t = targets.where("source IS NOT NULL").select("source", F.coalesce(F.greatest(F.col("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce(F.greatest(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # Bounded: the stated targets times 677 languages times the topics.
    cells = sizes.join(t, "source").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("size")).toPandas().sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    stated = t.toPandas().sort_values("source").reset_index(drop=True)
    at = {s: i for i, s in enumerate(stated.source)}
    source = cells.source.map(at).to_numpy(np.int64)
    size, cap = cells["size"].to_numpy(np.float64), stated.max_repeats.to_numpy(np.float64)
    available = np.bincount(source, size, minlength=len(stated)) if len(cells) else np.zeros(len(stated))
    wish = stated.weight.to_numpy(np.float64) * float(total)
    margins = [source, *(np.unique(cells[c], return_inverse=True)[1] for c in ("lang", "topic"))]
    rate = rake(size, margins, wish, cap)
    raked = np.bincount(source, size * rate, minlength=len(stated)) if len(cells) else np.zeros(len(stated))
    rows = [(r.source, float(r.weight), int(r.max_repeats), int(a), float(w), float(k), bool(k >= w * (1 - SLACK))) for r, a, w, k in zip(stated.itertuples(), available, wish, raked, strict=True)]
    sources = spark.createDataFrame(rows, "source string, weight double, max_repeats int, available long, target double, raked double, reachable boolean")
    rates = spark.createDataFrame([(r.source, r.lang, int(r.topic), float(x)) for r, x in zip(cells.itertuples(), rate, strict=True)], "source string, lang string, topic int, rate double")
    return sources, rates


def chosen(sizes: DataFrame, rates: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, lang, n_tokens, copies): documents used at least once and how often; the same for the same seed."""
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("rate")
    copies = (whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return sizes.join(rates, ["source", "lang", "topic"]).select("doc_id", "source", "lang", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(mixture: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, weight, reachable, n_docs, tokens, share): what each source really contributes."""
    used = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    whole = used.agg(F.sum("tokens")).scalar()
    tokens = F.coalesce("tokens", F.lit(0))
    return sources.join(used, "source", "left").select("source", "weight", "reachable", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), tokens.alias("tokens"), F.coalesce(tokens / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("share"))


def kept_promises(mixture: DataFrame, sources: DataFrame, rates: DataFrame, sizes: DataFrame, deviations: float = 5.0) -> DataFrame:
    """(source, reachable, n_over, n_repeated, in_bound) of each stated source: documents used more often than allowed, documents that
    have more than one row, and whether its tokens are within ``deviations`` standard deviations of the draw, plus one document, of
    those that the fit gives it."""
    part = F.col("rate") - F.floor("rate")
    spread = sizes.join(rates, ["source", "lang", "topic"]).groupBy("source").agg(F.sum(F.pow("n_tokens", F.lit(2)) * part * (1 - part)).alias("var"), F.max("n_tokens").alias("longest"))
    m = mixture.join(sources.select("source", "max_repeats"), "source").groupBy("source", "doc_id").agg(F.max(F.col("copies") - F.col("max_repeats")).alias("over"), F.count("*").alias("rows"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    m = m.groupBy("source").agg(F.count_if(F.col("over") > 0).alias("n_over"), F.count_if(F.col("rows") > 1).alias("n_repeated"), F.sum("tokens").alias("tokens"))
    zero = F.lit(0)
    off = F.abs(F.coalesce("tokens", zero) - F.col("raked"))
    in_bound = off <= F.coalesce(F.sqrt("var") * deviations + F.col("longest"), F.lit(0.0))
    return sources.join(spread, "source", "left").join(m, "source", "left").select("source", "reachable", F.coalesce("n_over", zero).alias("n_over"), F.coalesce("n_repeated", zero).alias("n_repeated"), in_bound.alias("in_bound"))
