"""Evaluation texts leaking into training text: latent semantic retrieval.

Passages and documents are reduced to letters and digits in lower case and cut into windows of WINDOW characters, half
overlapping. A window is a TF-IDF vector of the character GRAM-grams that occur in passages, hashed to 2 ** FEATURES
features, with frequencies counted over all documents. A randomised SVD of the passages' windows gives a latent space:
partitions add up A'(A omega) in slices, the sum is orthogonalised to Q, partitions add up (AQ)'(AQ), and its eigenvectors
turn Q into singular vectors; those of singular values near zero are left out. Each document window that holds enough of
the passages' grams is projected and compared by cosine with all passage windows; document and item become candidates at a
cosine of PARAPHRASE_COSINE, or where the hash of any run of RUN characters of the document is one of the item's, so no
shared run depends on the cosine. Candidates are then checked exactly: a shared run of RUN characters is a leak; otherwise
the longest common subsequence of the best windows and the presence of the answer together decide about a paraphrase.

The passages are the small side. What is broadcast is bounded by ITEMS of them, the latent space by 2 ** FEATURES times
RANK whatever their number. The documents are scanned once for the frequencies of all items and once for the search of
every ITEMS items, without a shuffle of their texts.

Defined results: null and empty texts, and passages shorter than RUN, leak nothing; copies of a document are reported
each; very long texts are read whole; documents or items without an id are left out; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.fingerprints import _BASE, gram_hashes, joined, mix
from terrane.runtime import spread

GRAM, WINDOW, RUN = 5, 80, 40
#: Most dimensions of the latent space (it grows with the root of the windows), least grams of a window that are known.
RANK, KNOWN = 256, 20
#: Hashed features of a window, and counters of the frequencies, as powers of two.
FEATURES, COUNTERS = 15, 20
#: Singular values below this share of the greatest are left out; rows of a slice of the sum.
FAINT, SLICE = 1e-3, 512
ITEMS = 16_000
#: A paraphrase: least cosine, and least share of the passage window in the common subsequence.
PARAPHRASE_COSINE, PARAPHRASE_LCS = 0.6, 0.6
_CHARS = 2_000_000
_SCHEMA = "doc_id bigint, item_id bigint, cosine double, run int, lcs double, answer boolean"


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in lower case, as code points in a row, and where each text begins."""
    c, at = joined([t.lower() for t in texts])
    keep = _alnum()[c]
    ends = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], ends[at]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of the grams within each text, and what `reduced` gives."""
    c, at = reduced(texts)
    h = gram_hashes(c, GRAM)
    size = np.maximum(np.diff(at) - GRAM + 1, 0)
    doc = np.repeat(np.arange(len(texts)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return h[pos + np.repeat(at[:-1], size)], doc, pos, c, at


class Vocabulary:
    """The grams of the passages, looked up by a bitmap first."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are known, their numbers)."""
        at = np.flatnonzero(self.map[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        n = np.minimum(np.searchsorted(self.hashes, h[at]), max(0, len(self.hashes) - 1))
        ok = self.hashes[n] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[ok], n[ok]


def _windows(doc: np.ndarray, pos: np.ndarray, feature: np.ndarray, least: int):
    """(doc, window, feature) of each known gram, once a window, for windows that hold at least `least` of them."""
    half = WINDOW // 2
    j = pos // half
    two = (j > 0) & (pos % half <= half - GRAM)
    d, w, f = np.concatenate([doc, doc[two]]), np.concatenate([j, j[two] - 1]), np.concatenate([feature, feature[two]])
    if not len(d):
        return d, w, f, np.zeros(0, np.int64)
    cell = d * (int(w.max()) + 1) + w
    o = np.lexsort((f, cell))
    d, w, f, cell = d[o], w[o], f[o], cell[o]
    once = np.concatenate([[True], (cell[1:] != cell[:-1]) | (f[1:] != f[:-1])])
    d, w, f, cell = d[once], w[once], f[once], cell[once]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    count = np.diff(np.append(start, len(cell)))
    keep = np.repeat(count >= least, count)
    d, w, f = d[keep], w[keep], f[keep]
    count = count[count >= least]
    return d, w, f, np.cumsum(count) - count


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHARS:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]


def _known_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, texts in _texts(b):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_grams(texts)[0] >> np.uint64(64 - COUNTERS)).astype(np.int64))], ["counter"])


def _frequencies(shared):
    """Documents that hold a gram of each of the passages' counters; -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        count, docs = np.zeros(1 << COUNTERS, np.int64), 0
        for b in batches:
            for _, texts in _texts(b):
                h, doc, _, _, _ = _grams(texts)
                counter = (h >> np.uint64(64 - COUNTERS)).astype(np.int64)
                at = np.flatnonzero(wanted[counter])
                count += np.bincount(np.unique(doc[at] << COUNTERS | counter[at]) & ((1 << COUNTERS) - 1), minlength=1 << COUNTERS)
                docs += len(texts)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], docs))], ["counter", "n"])

    return run


class Space:
    """The grams of the passages with their features and weights, and the basis of the latent space."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        self.vocab = Vocabulary(hashes)
        self.idf = idf[(self.vocab.hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)]
        self.feature = (self.vocab.hashes >> np.uint64(64 - FEATURES)).astype(np.int64)
        self.basis = np.zeros((1 << FEATURES, 1), np.float32)

    def windows(self, texts: list[str], least: int):
        """(text, window, gram, start of each window, unit weights of the grams) of the windows with enough known grams, and
        what `reduced` gives."""
        h, doc, pos, c, at_text = _grams(texts)
        at, n = self.vocab.find(h)
        d, w, f, start = _windows(doc[at], pos[at], n, least)
        norm = np.sqrt(np.add.reduceat(self.idf[f] ** 2, start)) if len(start) else np.zeros(0, np.float32)
        return d, w, f, start, self.idf[f] / np.repeat(norm, np.diff(np.append(start, len(f)))), (c, at_text)


def _sum_up(parts: DataFrame, columns: int) -> dict[int, np.ndarray]:
    """Sums of float matrices (slice, part) of equal slices, added in partitions before the shuffle and after it."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32) for x in table.column("part").to_pylist()], axis=0, dtype=np.float32)
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    return {k: np.frombuffer(v, np.float32).reshape(-1, columns) for k, v in parts.groupBy("slice").applyInArrow(add, "slice int, part binary").collect()}


def _range(shared, rank: int):
    """A'(A omega) of the partition's windows, in slices of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        omega = np.random.default_rng(7).standard_normal((1 << FEATURES, rank)).astype(np.float32)
        total = np.zeros_like(omega)
        for b in batches:
            for _, texts in _texts(b):
                _, _, f, start, v, _ = space.windows(texts, 1)
                if len(start):
                    at = space.feature[f]
                    y = np.add.reduceat(omega[at] * v[:, None], start)
                    np.add.at(total, at, np.repeat(y, np.diff(np.append(start, len(f))), axis=0) * v[:, None])
        for s in range(0, len(total), SLICE):
            if total[s : s + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([total[s : s + SLICE].tobytes()], pa.binary())], ["slice", "part"])

    return run


def _square(shared):
    """(AQ)'(AQ) of the partition's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        total = np.zeros((space.basis.shape[1],) * 2, np.float32)
        for b in batches:
            for _, texts in _texts(b):
                _, _, f, start, v, _ = space.windows(texts, 1)
                if len(start):
                    y = np.add.reduceat(space.basis[space.feature[f]] * v[:, None], start)
                    total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])

    return run


def decompose(items: DataFrame, space: Space, windows: int) -> np.ndarray:
    """Sets the right singular vectors of the passages' windows as the basis; returns the singular values."""
    sc = items.sparkSession.sparkContext
    rank = max(1, min(RANK, 4 * math.ceil(math.sqrt(windows)), windows))
    y = np.zeros((1 << FEATURES, rank), np.float32)
    for s, part in _sum_up(items.select("item_id", "passage").mapInArrow(_range(sc.broadcast(space), rank), "slice int, part binary"), rank).items():
        y[s : s + len(part)] = part
    space.basis = np.linalg.qr(y)[0].astype(np.float32)
    square = _sum_up(items.select("item_id", "passage").mapInArrow(_square(sc.broadcast(space)), "slice int, part binary"), rank)[0]
    values, vectors = np.linalg.eigh(square.astype(np.float64))
    singular = np.sqrt(np.maximum(values, 0))
    keep = np.flatnonzero(singular >= FAINT * max(singular.max(), 1e-12))[::-1]
    space.basis = (space.basis @ vectors[:, keep]).astype(np.float32)
    return singular[keep]


def _latent(space: Space, f: np.ndarray, start: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Unit vectors of the windows in the latent space."""
    out = np.empty((len(start), space.basis.shape[1]), np.float32)
    stop = np.append(start[1:], len(f))
    for s in range(0, len(start), 2000):  # bounds the gathered rows
        a, b = start[s], stop[min(s + 2000, len(start)) - 1]
        out[s : s + 2000] = np.add.reduceat(space.basis[space.feature[f[a:b]]] * v[a:b, None], start[s : s + 2000] - a)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def run_hashes(c: np.ndarray, n: int = RUN) -> np.ndarray:
    """A hash of the n characters that begin at each position, put together from runs of doubled length."""
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h, out, done, size, base = c.astype(np.uint64) + np.uint64(1), None, 0, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                part = h[done : done + m]
                out = part.copy() if out is None else out * base + part
                done += size
            if 2 * size > n:
                return mix(out)
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2


def longest_run(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: int = RUN) -> int:
    """Length of the longest run of a and b, 0 if under `least`; x and y are their `run_hashes`, y sorted."""
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    hit = np.flatnonzero(y[at] == x) if len(y) and len(x) else np.zeros(0, np.int64)
    if not len(hit):
        return 0
    s, t = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
    best, edge = 0, np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
    for i, j in zip(hit[edge].tolist(), hit[np.append(edge[1:], len(hit)) - 1].tolist()):
        while j - i + least > best:  # hits in a row are one run, or runs that follow each other
            n = j - i + least
            if _holds(t, s[4 * i : 4 * (i + n)]):
                best = n
                break
            k = i + max(least, best + 1)
            while k - i <= n and _holds(t, s[4 * i : 4 * k]):
                best, k = k - i, k + 1
            i += 1
    return best


def _holds(text: bytes, part: bytes) -> bool:
    at = text.find(part)
    while at >= 0 and at % 4:
        at = text.find(part, at + 1)
    return at >= 0


class Runs:
    """The run hashes of all passages, and the items each belongs to."""

    def __init__(self, hashes: list[np.ndarray]):
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        o = np.argsort(h, kind="stable")
        self.known, self.items = Vocabulary(h), item[o]
        self.start = np.append(np.searchsorted(h[o], self.known.hashes), len(h))

    def pairs(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item), once each, that share a run; h: the run hashes of all texts in a row, which begin at `at`."""
        pos, n = self.known.find(h)
        text = np.searchsorted(at, pos, "right") - 1
        ok = pos + RUN <= at[text + 1]  # runs that lie in one text
        text, n = text[ok], n[ok]
        times = self.start[n + 1] - self.start[n]
        item = self.items[np.repeat(self.start[n] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        pair = np.unique(np.repeat(text, times) * (int(self.items.max(initial=0)) + 1) + item)
        return np.divmod(pair, int(self.items.max(initial=0)) + 1)


def _search(shared, exact_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items, item_vectors, owner, place, passage_runs = shared.value
        for b in batches:
            rows = []
            for ids, texts in _texts(b):
                d, w, f, start, v, (c, at) = space.windows(texts, KNOWN)
                all_runs = run_hashes(c)
                ks, its = passage_runs.pairs(all_runs, at)
                exact = set(zip(ks.tolist(), its.tolist()))
                vectors = _latent(space, f, start, v)
                hits = [(ks, its, np.full(len(ks), -2.0, np.float32), np.full(len(ks), -1), np.full(len(ks), -1))]
                for r, (k, item) in enumerate(zip(ks.tolist(), its.tolist())):  # the best windows of a pair with a shared run
                    a, b = np.searchsorted(d[start], [k, k + 1])
                    x, y = np.searchsorted(owner, [item, item + 1])
                    if a < b and x < y:
                        cos = vectors[a:b] @ item_vectors[x:y].T
                        i, j = np.unravel_index(cos.argmax(), cos.shape)
                        for column, v in zip(hits[0][2:], (cos[i, j], w[start[a + i]], place[x + j])):
                            column[r] = v
                for s in range(0, len(vectors), 4000):
                    cos = vectors[s : s + 4000] @ item_vectors.T
                    i, j = np.nonzero(cos >= PARAPHRASE_COSINE)
                    hits.append((d[start[s + i]], owner[j], cos[i, j], w[start[s + i]], place[j]))
                ds, js, cs, mine, theirs = (np.concatenate(x) for x in zip(*hits))
                o = np.lexsort((-cs, js, ds))
                ds, js, cs, mine, theirs = ds[o], js[o], cs[o], mine[o], theirs[o]
                best = np.flatnonzero(np.concatenate([[True], (ds[1:] != ds[:-1]) | (js[1:] != js[:-1])])) if len(ds) else ()
                for r in best:
                    k, item = int(ds[r]), int(js[r])
                    text = c[at[k] : at[k + 1]]
                    item_id, passage, answer, runs = items[item]
                    shared_run = longest_run(text, passage, all_runs[at[k] : max(at[k], at[k + 1] - RUN + 1)], runs) if (k, item) in exact else 0
                    lcs, has = None, None
                    if not exact_only and mine[r] >= 0 and (shared_run or cs[r] >= PARAPHRASE_COSINE):
                        half = WINDOW // 2
                        this = text[mine[r] * half : mine[r] * half + WINDOW].tolist()
                        other = passage[theirs[r] * half : theirs[r] * half + WINDOW].tolist()
                        lcs = common("".join(map(chr, this)), "".join(map(chr, other))) / max(1, len(other))
                    if not exact_only:
                        has = len(answer) > 0 and _holds(text.astype("<u4").tobytes(), answer.astype("<u4").tobytes())
                    if shared_run or (lcs is not None and has and lcs >= PARAPHRASE_LCS):
                        rows.append((int(ids[k]), item_id, float(cs[r]) if mine[r] >= 0 else None, shared_run, lcs, has))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["doc_id", "item_id", "cosine", "run", "lcs", "answer"])

    return run


def _one_scan(docs: DataFrame, items: DataFrame, idf: np.ndarray, exact_only: bool) -> DataFrame | None:
    rows = [r for r in items.collect() if r[1]]  # at most ITEMS passages
    if not rows:
        return None
    texts, answers = [r[1] for r in rows], reduced([r[2] or "" for r in rows])
    space = Space(_grams(texts)[0], idf)
    d, w, f, start, v, (c, at) = space.windows(texts, 1)
    decompose(items, space, len(start))
    vectors = _latent(space, f, start, v)
    own = [(r[0], c[at[i] : at[i + 1]], answers[0][answers[1][i] : answers[1][i + 1]], np.unique(run_hashes(c[at[i] : at[i + 1]]))) for i, r in enumerate(rows)]
    shared = docs.sparkSession.sparkContext.broadcast((space, own, vectors, d[start] if len(start) else d, w[start] if len(start) else w, Runs([x[3] for x in own])))
    return docs.mapInArrow(_search(shared, exact_only), _SCHEMA)


def _weights(docs: DataFrame, items: DataFrame) -> np.ndarray:
    """Inverse document frequency of every counter, from one scan of the documents for all items."""
    sc = docs.sparkSession.sparkContext
    wanted = np.zeros(1 << COUNTERS, bool)
    wanted[[r[0] for r in items.select("item_id", "passage").mapInArrow(_known_counters, "counter bigint").distinct().collect()]] = True
    df, total = np.zeros(1 << COUNTERS), 0
    for k, n in docs.mapInArrow(_frequencies(sc.broadcast(wanted)), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n")).collect():  # one row a counter at most
        if k < 0:
            total = n
        else:
            df[k] = n
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


def leaks(documents: DataFrame, items: DataFrame, exact_only: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, run, lcs, answer): every document and item that share a passage, fully or partly.

    run is the longest shared run, or 0 where the passage is paraphrased; cosine and lcs are null where no window of the
    document holds enough of the passages' grams; lcs is the share of the best passage window in
    the common subsequence; answer tells whether the item's answer stands in the document.
    """
    docs = spread(documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0"), "doc_id")
    slim = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage", "answer").where("item_id is not null and length(passage) > 0")
    n = slim.count()
    if not n:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    idf, blocks = _weights(docs, slim), max(1, -(-n // ITEMS))
    parts = [_one_scan(docs, slim.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else slim, idf, exact_only) for k in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    return reduce(DataFrame.unionByName, parts)
