"""Evaluation texts in a corpus: latent semantic retrieval of passages, then exact and paraphrase checks.

1. Documents become word lists, cut into overlapping segments of bounded length, written once as a table of word hashes.
2. Document frequencies of the hashed terms, and how often each shingle of the test set occurs, are counted over the whole corpus.
3. A randomised SVD of TF-IDF passages gives the latent space. It is fitted on the passages of the test items and a bounded
   sample of corpus passages; its products A'(A Y) are computed by the executors, partition by partition.
4. Passages meet in inverted lists: a pair that shares ``need`` shingles (or words) of a test passage of n shares h of the
   n - need + h that are rarest in the corpus, for any h. Only these have lists, so a corpus passage meets few test passages,
   however many there are. The pairs that meet often enough are compared by cosine in the latent space.
5. Candidates are checked word by word for a run of common words, or for the longest common subsequence and the answer.
   A pair below the cosine is checked as well where it shares as many words as the check takes, so none is lost.

Test items are taken in blocks of bounded size, each of which searches the whole word table.
Passage lengths and strides are chosen so that any run of ``RUN`` words lies whole in one passage on either side.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import arrow
from spanloom.shared import release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words in a row that count as a leak.
RUN = 12
#: Corpus passages are SPAN blocks long and begin at every block; test passages have their own length and stride.
BLOCK, SPAN = 6, 3
LENGTH, OVER = BLOCK * SPAN, BLOCK * (SPAN - 1)
ITEM_LENGTH, ITEM_STRIDE = 18, 7
#: Hashed terms, latent dimensions, extra directions of the random start, rounds of the power iteration.
TERMS, RANK, EXTRA, ROUNDS = 8192, 128, 16, 2
#: Bound of the sample that the latent space is fitted on: corpus passages, about.
FIT_PASSAGES = 20000
FIT_PARTS = 8
#: Least cosine of a candidate of the latent space.
COSINE = 0.45
#: Words of a listed shingle where a run is searched for; a paraphrase keeps words, not shingles, so there single words are listed.
SHINGLE = 3
#: Listed shingles, or words, that a pair of passages must share to be compared.
HITS, WORD_HITS = 3, 3
#: Words of test items that are searched at once, about: they and their vectors are what a task holds (some 20 MB).
ITEM_WORDS = 200_000
#: Words of the corpus, and meetings with test passages, that a task holds at once.
SLICE, MEETINGS = 1 << 15, 1 << 22
#: Words of a segment, beside the OVER words that it shares with the next.
SEGMENT = BLOCK * 680

_WORD = re.compile(r"[^\W_]+")
_NOT_TEXT = re.compile(r"^[^\S\r\n]*[0-9]+[^\S\r\n]*$|^.*-->.*$", re.M)
_MARK = re.compile(r"<[^>\n]*>|\{[^}\n]*\}")


def spoken_words(text: str) -> list[str]:
    """Lower-case words of a subtitle file without numbers of cues, times and marks."""
    return _WORD.findall(_MARK.sub(" ", _NOT_TEXT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))).lower())


def item_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h


def _hasher():
    at = _Hashes().__getitem__
    return lambda words: np.fromiter(map(at, words), np.int64, len(words))


def word_table(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, seg, words): hashes of each document's spoken words, in segments. Null and wordless texts have none."""

    def split(batches):
        hashed = _hasher()
        for b in arrow.parts(batches):
            docs, segs, offsets, parts, at = [], [], [0], [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = hashed(spoken_words(t))
                for k in range(0, max(1, len(w) - OVER), SEGMENT):
                    part = w[k : k + SEGMENT + OVER]
                    if len(part):
                        docs.append(doc)
                        segs.append(k // SEGMENT)
                        parts.append(part)
                        at += len(part)
                        offsets.append(at)
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(segs, pa.int32()), words], ["doc", "seg", "words"])

    rows = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    return written(rows.mapInArrow(split, "doc long, seg int, words array<long>"), "words")


def _lists(batch) -> tuple[np.ndarray, np.ndarray]:
    """Flat words and offsets of a batch's word lists."""
    c = batch.column(batch.schema.get_field_index("words"))
    offsets = c.offsets.to_numpy()
    return c.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(batch, most: int = SLICE):
    """Flat words, offsets and documents of parts of a batch, each of about ``most`` words, to bound memory."""
    flat, offsets = _lists(batch)
    docs = batch.column(batch.schema.get_field_index("doc")).to_numpy()
    k = 0
    while k < len(docs):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, side="right")) - 1)
        yield flat[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k], docs[k:to]
        k = to


def _terms(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(17)).astype(np.int64) % TERMS


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on; words after the end count as 0. Single words are as they are."""
    if n == 1 or not len(words):
        return words
    out, mult = np.zeros(words.shape, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(n):
            out *= mult
            out ^= out >> np.uint64(31)
            out[..., : words.shape[-1] - j] += words.view(np.uint64)[..., j:]
    return out.view(np.int64)


def _frequencies(words: DataFrame, vocabulary: np.ndarray, shingle: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Segments that hold each hashed term, segments, and occurrences of the shingles in ``vocabulary`` (sorted), over the whole
    corpus. As many numbers come back as there are terms and shingles of the test items."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        total = np.zeros(TERMS + 1 + len(known), np.int64)
        for b in batches:
            for flat, offsets, _ in _slices(b):
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                seen = np.unique(row * TERMS + _terms(flat))
                total[:TERMS] += np.bincount(seen % TERMS, minlength=TERMS)
                total[TERMS] += len(offsets) - 1
                tokens = _shingles(flat, shingle)
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                total[TERMS + 1 :] += np.bincount(at[known[at] == tokens], minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    counts = words.select("doc", "words").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1 + len(vocabulary))
    out[counts.term] = counts.n
    shared.unpersist()
    return out[:TERMS], int(out[TERMS]), out[TERMS + 1 :]


def _blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the blocks of BLOCK words in every list, the list of each, and the blocks that follow it in its list."""
    blocks = -(-np.diff(offsets) // BLOCK)
    row = np.repeat(np.arange(len(blocks)), blocks)
    index = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return offsets[:-1][row] + index * BLOCK, row, blocks[row] - 1 - index


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)


def _gram(flat: np.ndarray, starts: np.ndarray, passage: np.ndarray, idf: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A'(A y) of TF-IDF passages, each of unit length; ``passage`` names the passage of each of the words in ``flat``."""
    terms = _terms(flat)
    order = np.lexsort((terms, passage))
    p, t = passage[order], terms[order]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (t[1:] != t[:-1])])
    tf = np.diff(np.r_[new, len(p)])
    p, t = p[new], t[new]
    w = (tf * idf[t]).astype(np.float32)
    norm = np.sqrt(np.bincount(p, w * w))
    w /= np.maximum(norm[p], 1e-12).astype(np.float32)
    z = np.add.reduceat(y[t] * w[:, None], np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), axis=0)
    dense = np.cumsum(np.r_[True, p[1:] != p[:-1]]) - 1
    by = np.argsort(t, kind="stable")
    g = np.zeros_like(y)
    ts = t[by]
    first = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
    g[ts[first]] = np.add.reduceat(z[dense[by]] * w[by][:, None], first, axis=0)
    return g


def _item_passages(items: list[tuple[int, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    parts, ids = [], []
    for item, w in items:
        starts = list(range(0, max(1, len(w) - ITEM_LENGTH + 1), ITEM_STRIDE))
        if len(w) > ITEM_LENGTH and starts[-1] != len(w) - ITEM_LENGTH:
            starts.append(len(w) - ITEM_LENGTH)
        for s in starts:
            parts.append(w[s : s + ITEM_LENGTH])
            ids.append(item)
    return parts, np.array(ids, np.int64)


def _corpus_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all passages, each word once for every passage it lies in, and their passages."""
    starts, row, _ = _blocks(offsets)
    block = np.searchsorted(starts, np.arange(len(flat)), side="right") - 1
    words, passages = [flat], [block]
    for k in range(1, SPAN):
        before = np.maximum(block - k, 0)
        inside = (block >= k) & (row[before] == row[block])
        words.append(flat[inside])
        passages.append(before[inside])
    return np.concatenate(words), np.concatenate(passages)


def fit(words: DataFrame, items: list[tuple[int, np.ndarray]], df: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """TERMS x RANK matrix that maps a passage's term counts into the latent space (idf included).

    ``df`` and ``n`` are the whole corpus' frequencies. The random start is fixed by ``seed``; the sample of passages is chosen by a
    hash of its document and segment.
    """
    flat = np.concatenate([w for _, w in items])
    # Only terms of the test set have weight, so that what surrounds a leaked passage doesn't hide it; of those every one has,
    # also where all segments hold it.
    idf = np.where(np.bincount(_terms(flat), minlength=TERMS) > 0, 1 + np.log((n + 1) / (df + 1)), 0).astype(np.float32)
    n_passages = words.agg(F.sum(F.ceil(F.size("words") / F.lit(BLOCK)))).first()[0] or 0
    share = min(1.0, FIT_PASSAGES / max(1, n_passages))
    picked = words.where(F.pmod(F.xxhash64("doc", "seg"), F.lit(1 << 30)) < int(share * (1 << 30))).select("words").repartition(FIT_PARTS)
    sample = written(picked, "fit")
    parts, _ = _item_passages(items)
    flat = np.concatenate(parts)
    passage = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    y = np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA)).astype(np.float32)
    spark = words.sparkSession

    def product(y: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(y)

        def partial(batches):
            g = np.zeros_like(shared.value)
            for b in batches:
                w, offsets = _lists(b)
                if len(w):
                    corpus, of = _corpus_words(w, offsets)
                    g += _gram(corpus, offsets, of, idf, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

        total = _gram(flat, np.zeros(1), passage, idf, y)
        # At most a part's product for each of the sample's files: TERMS x (RANK + EXTRA) numbers.
        for (g,) in sample.mapInArrow(partial, "g binary").toLocalIterator():
            total += np.frombuffer(g, np.float32).reshape(total.shape)
        shared.unpersist()
        return total

    for _ in range(ROUNDS):
        y, _ = np.linalg.qr(product(y))
        y = y.astype(np.float32)
    _, u = np.linalg.eigh(y.T @ product(y))
    release(sample)
    v = y @ u[:, ::-1][:, :RANK]
    return (v * idf[:, None]).astype(np.float32)


def _grams(w: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Hashes of the runs of RUN words that begin at each place of each passage; 0 where none fits."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    x = w.view(np.uint64)
    at = starts[:, None] + np.arange(most - RUN + 1)[None, :]
    fits = np.arange(most - RUN + 1)[None, :] + RUN <= lengths[:, None]
    at = np.where(fits, at, 0)
    h = np.zeros(at.shape, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(RUN):
            h = (h ^ x[np.minimum(at + j, len(x) - 1)]) * mult
            h ^= h >> np.uint64(29)
    return np.where(fits, h | np.uint64(1), np.uint64(0))


def lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of row i of ``a`` and row i of ``b``, for all rows at once; pad with
    different negative numbers."""
    best = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        same = a[:, i : i + 1] == b
        above = best.copy()
        for j in range(b.shape[1]):
            best[:, j + 1] = np.maximum(np.where(same[:, j], above[:, j] + 1, above[:, j + 1]), best[:, j])
    return best[:, -1]


def _index(tokens: np.ndarray, lengths: np.ndarray, need: np.ndarray, hits: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists (keys, first place, test passages) of the passages' rarest tokens.

    A pair that shares the tokens of ``need`` places of a test passage shares those of ``hits`` of any length - need + hits places.
    ``count`` says how often the token of each place occurs in the corpus. Passages shorter than their ``need`` have no list.
    """
    places = np.arange(tokens.shape[1])[None, :]
    order = np.argsort(np.where(places < lengths[:, None], count, np.inf), axis=1, kind="stable")
    chosen = (places < (lengths - need + hits)[:, None]) & (need <= lengths)[:, None]
    q, j = np.nonzero(chosen)
    keys = tokens[q, order[q, j]]
    by = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[by], return_index=True)
    return distinct, np.r_[first, len(by)], q[by]


def _item_matrix(items: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat words, lengths, words row by row padded with -1, item) of all test passages."""
    parts, at = _item_passages([(i, w) for i, (_, w, _) in enumerate(items)])
    lengths, flat = np.array([len(p) for p in parts]), np.concatenate(parts)
    words = np.full((len(parts), ITEM_LENGTH), -1, np.int64)
    words[np.arange(ITEM_LENGTH)[None, :] < lengths[:, None]] = flat
    return flat, lengths, words, at


def _vocabulary(items: list[tuple[int, np.ndarray, np.ndarray]], shingle: int) -> np.ndarray:
    _, lengths, words, _ = _item_matrix(items)
    tokens = _shingles(words, shingle)
    return np.unique(np.r_[tokens[np.arange(ITEM_LENGTH)[None, :] + shingle <= lengths[:, None]], 0])


def _search_tables(items: list[tuple[int, np.ndarray, np.ndarray]], e: np.ndarray, vocabulary: np.ndarray, count: np.ndarray, needed, shingle: int, hits: int) -> SimpleNamespace:
    """Everything about a block of test items that a search task needs. Plain arrays, so that workers need no module to read it.
    ``needed`` gives the words that a passage of each length must share."""
    flat, lengths, words, at = _item_matrix(items)
    starts = np.cumsum(lengths) - lengths
    need = needed(lengths)
    tokens = _shingles(words, shingle)
    often = count[np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)]
    hits = np.minimum(hits, need - shingle + 1)
    z = _unit(np.add.reduceat(e[_terms(flat)], starts, axis=0)).astype(np.float32)
    return SimpleNamespace(
        ids=np.array([items[i][0] for i in at], np.int64), lengths=lengths, z=z, e=e, need=need, shingle=shingle, hits=hits,
        index=_index(tokens, lengths - shingle + 1, need - shingle + 1, hits, often), grams=_grams(flat, starts, lengths, ITEM_LENGTH), words=words, answers=[items[i][2] for i in at],
    )


def _met(w: np.ndarray, offsets: np.ndarray, items: SimpleNamespace):
    """Corpus passages and test passages that share enough listed tokens, and of all passages starts, lists and lengths."""
    starts, row, _ = _blocks(offsets)
    ends = offsets[1:][row]
    lengths = np.minimum(starts + LENGTH, ends) - starts
    # What begins after a passage that reaches the list's end is part of that.
    whole = (starts == offsets[:-1][row]) | (starts - BLOCK + LENGTH < ends)
    size, tokens = len(items.lengths), _shingles(w, items.shingle)
    keys, first, passages = items.index
    at = np.minimum(np.searchsorted(keys, tokens), max(len(keys) - 1, 0))
    place = np.flatnonzero(keys[at] == tokens) if len(keys) else np.zeros(0, np.int64)
    n = first[at[place] + 1] - first[at[place]]
    block, upto, met, k = np.searchsorted(starts, place, side="right") - 1, np.cumsum(n), [], 0
    while k < len(place):
        to = max(k + 1, int(np.searchsorted(upto, upto[k] - n[k] + MEETINGS, side="right")))
        m = n[k:to]
        q = passages[np.arange(m.sum()) + np.repeat(first[at[place[k:to]]] - (np.cumsum(m) - m), m)]
        met.append(np.unique(np.repeat(block[k:to], m) * size + q, return_counts=True))
        k = to
    if not met:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), starts, row, lengths
    code, hits = (np.concatenate(x) for x in zip(*met, strict=True))
    # A block lies in the passages that begin with it and with each of the SPAN - 1 before it.
    block, both = code // size, [(code, hits)]
    for k in range(1, SPAN):
        ok = (block >= k) & (row[np.maximum(block - k, 0)] == row[block])
        both.append((code[ok] - k * size, hits[ok]))
    code, hits = (np.concatenate(x) for x in zip(*both, strict=True))
    by = np.argsort(code, kind="stable")
    code, hits = code[by], hits[by]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    total, code = np.add.reduceat(hits, new), code[new]
    p, q = np.divmod(code[total >= items.hits[code % size]], size)
    ok = whole[p]
    return p[ok], q[ok], starts, row, lengths


def _enough(mine: np.ndarray, q: np.ndarray, items: SimpleNamespace) -> np.ndarray:
    """Whether enough places of each test passage have a word of the corpus passage beside it."""
    both = np.zeros(len(q), np.int8)
    words = items.words[q]
    for j in range(ITEM_LENGTH):
        both += (mine == words[:, j : j + 1]).any(1)
    return both >= items.need[q]


def _candidates(w: np.ndarray, offsets: np.ndarray, items: SimpleNamespace, cosine: float | None):
    """Yield (corpus passages, their words, test passages, cosines, and of all passages starts, lists and lengths) of the pairs that
    reach ``cosine`` or, below it, share enough words. Without a cosine the words alone decide, and it is computed after."""
    p, q, starts, row, lengths = _met(w, offsets, items)
    for k in range(0, len(p), 20000):
        pk, qk = p[k : k + 20000], q[k : k + 20000]
        mine = _passages(w, starts[pk], lengths[pk], -2)
        s = None if cosine is None else _cosines(w, starts[pk], lengths[pk], qk, items)
        ok = np.zeros(len(pk), bool) if cosine is None else s >= cosine
        ok[~ok] = _enough(mine[~ok], qk[~ok], items)
        if ok.any():
            yield pk[ok], mine[ok], qk[ok], None if s is None else s[ok], starts, row, lengths


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(id, words, words of the answer) of the test items, in blocks of about ITEM_WORDS words; the driver holds one at a time.

    The answer's words are numbers and names, by which a paraphrase is told from a text of the same make."""
    hashed, block, size = _hasher(), [], 0
    for i, t in items.select(F.col(key).cast("long"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        w = hashed(item_words(t))
        if len(w):
            block.append((i, w, hashed(sorted({x.lower() for x in re.findall(r"(?<=[\w,;] )[A-Z][^\W_]*|[0-9]+", t)}))))
            size += len(w)
        if size >= ITEM_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searched(words: DataFrame, items: DataFrame, key: str, text: str, needed, shingle: int, hits: int, search, schema: str) -> DataFrame:
    """The union of ``search(tables, flat words, offsets, documents)`` over all slices of the word table and all blocks of items."""
    context, out = words.sparkSession.sparkContext, []
    blocks = _item_blocks(items, key, text)
    block = next(blocks, None)
    while block is not None:
        vocabulary = _vocabulary(block, shingle)
        df, n, count = _frequencies(words, vocabulary, shingle)
        shared = context.broadcast(_search_tables(block, fit(words, [(i, w) for i, w, _ in block], df, n), vocabulary, count, needed, shingle, hits))

        def run(batches, shared=shared):
            for b in batches:
                for w, offsets, docs in _slices(b):
                    yield from search(shared.value, w, offsets, docs)

        found = words.select("doc", "words").mapInArrow(run, schema)
        block = next(blocks, None)
        if block is not None or out:
            # Of several blocks each is searched at once, so that only one block's tables exist at a time.
            found = written(found, "block")
            shared.unpersist()
        out.append(found)
    whole = out[0] if out else words.sparkSession.createDataFrame([], schema)
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, n_runs): documents that contain RUN consecutive words of an item, with the best cosine of the
    passages that show it and their number.

    Candidates are the pairs of passages that share HITS of the test passage's rarest shingles and whose cosine in the latent space is
    at least ``cosine``; below it those that share RUN words, as all that show a leak do, so no leak depends on the cosine. Every one
    is checked, there is no cap on them. Null texts and ids, texts without words and items of fewer than RUN words match
    nothing; equal documents match each; an empty table gives no rows. Columns beyond those named don't matter. Items are
    searched in blocks, so their number isn't bounded.
    """
    words = word_table(documents, text, key)

    def search(it, w, offsets, docs):
        hits = []
        for p, _, q, s, starts, row, lengths in _candidates(w, offsets, it, cosine):
            distinct, where = np.unique(p, return_inverse=True)
            g = _grams(w, starts[distinct], lengths[distinct], LENGTH)
            g, hit = g[where], np.zeros(len(p), bool)
            for j in range(it.grams.shape[1]):
                mine = it.grams[q, j]
                hit |= (mine != 0) & (g == mine[:, None]).any(1)
            hits.append((docs[row[p[hit]]], it.ids[q[hit]], s[hit]))
        if hits:
            doc, item, s = (np.concatenate(x) for x in zip(*hits, strict=True))
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(item), pa.array(s), pa.array(np.ones(len(doc), np.int64))], ["doc", "item", "cosine", "n"])

    out = _searched(words, items, item_key, item_text, lambda n: np.where(n >= RUN, RUN, LENGTH + 1), SHINGLE, HITS, search, "doc long, item long, cosine float, n long")
    return out.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(F.max("cosine").alias("cosine"), F.sum("n").alias("n_runs"))


def _passages(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """Row by row the values of passages of LENGTH words, padded."""
    at = starts[:, None] + np.arange(LENGTH)[None, :]
    inside = np.arange(LENGTH)[None, :] < lengths[:, None]
    return np.where(inside, values[np.minimum(at, len(values) - 1)], pad)


def _cosines(w: np.ndarray, starts: np.ndarray, lengths: np.ndarray, q: np.ndarray, items: SimpleNamespace) -> np.ndarray:
    """Cosines in the latent space of corpus passages and the item passages ``q``."""
    z = np.zeros((len(q), items.e.shape[1]), np.float32)
    terms = _passages(_terms(w), starts, lengths, -1)
    for j in range(LENGTH):
        z += np.where(terms[:, j : j + 1] >= 0, items.e[terms[:, j]], 0)
    return (_unit(z) * items.z[q]).sum(1).astype(np.float32)


def paraphrases(documents: DataFrame, items: DataFrame, cosine: float | None = None, least_lcs: float = 0.6, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answered): documents with a passage whose longest common subsequence with an item's passage
    covers at least ``least_lcs`` of that. ``answered`` tells whether the passage holds one of the item's numbers or names, if it
    has any; ``cosine`` is that of the two passages in the latent space. Inputs as in :func:`leaks`; of a pair's passages the
    best counts.

    Every pair of passages that shares the words which such a subsequence takes is checked, so none is lost. A ``cosine``
    leaves out the pairs of passages below it; by default none are.
    """
    words = word_table(documents, text, key)

    def search(it, w, offsets, docs):
        for p, mine, q, _, starts, row, lengths in _candidates(w, offsets, it, None):
            share = lcs(mine, it.words[q]) / it.lengths[q]
            ok = share >= least_lcs
            p, q, mine, share = p[ok], q[ok], mine[ok], share[ok]
            s = _cosines(w, starts[p], lengths[p], q, it)
            if cosine is not None:
                ok = s >= cosine
                p, q, s, mine, share = p[ok], q[ok], s[ok], mine[ok], share[ok]
            if len(p):
                said = [bool(np.isin(m, it.answers[i]).any()) if len(it.answers[i]) else True for m, i in zip(mine, q.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[row[p]]), pa.array(it.ids[q]), pa.array(s), pa.array(share.astype(np.float64)), pa.array(said)], ["doc", "item", "cosine", "lcs", "answered"])

    def needed(n):
        # The least common words that reach the share, by the same division as above.
        reach = np.arange(ITEM_LENGTH + 1)[None, :] / n[:, None] >= least_lcs
        return np.where(reach.any(1), np.maximum(1, reach.argmax(1)), LENGTH + 1)

    out = _searched(words, items, item_key, item_text, needed, 1, WORD_HITS, search, "doc long, item long, cosine float, lcs double, answered boolean")
    best = F.max(F.struct("answered", "lcs", "cosine")).alias("b")
    return out.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(best).select(key, item_key, "b.cosine", "b.lcs", "b.answered")


__all__ = ["fit", "item_words", "lcs", "leaks", "paraphrases", "spoken_words", "word_table"]
