"""Near-duplicate records with small edits: meet-in-the-middle ball hashing on min-hash fingerprints.

1. Contents are compared in lower case with runs of whitespace as one space; equal contents are grouped by a 128-bit
   digest, and only one record of each takes part in what follows.
2. A content has TABLES fingerprints of WIDTH min-hash symbols. Every fingerprint emits itself and all variants within
   half the radius, which is one symbol replaced by its runner-up, so fingerprints within the radius of two meet on a
   variant. A plain bit-flip ball is no use here: at a similarity of 0.65 a 64-bit simhash differs in about 13 bits, and
   the balls of such a radius cannot be enumerated; with symbols a radius of two is enough.
3. Variants are shuffled in packed blocks. The records of one variant are paired with its pivots, the shortest records in
   it: three where few records meet, one where many do, so the pairs grow with the records and never with their square.
   A variant that many records of a batch share sends only its pivots on, its members are joined with the pivots later.
4. A pair goes on if the sketches of its ends (128 min-hash symbols of four bits) agree as often as those of pairs well
   below the threshold do, and is then verified exactly on the texts.
5. Records that share much with a pivot but stay below the threshold (a page template, say) are refined: if two of them are
   linked and the pivot is no longer than either, they share shingles outside the pivot. What such a record holds beyond
   each of its pivots is hashed again, alone, in twos and in fours, and meets within the pivot's records as in 3 and 4.
6. Verified links give the groups as connected components. Where links are counted, all pairs of different contents
   within a group are verified.

Recall is that of the fingerprints and of the refinement; README has the measured figures. WIDTH sets how many unlike
records meet by chance and should grow by one where a corpus grows a hundredfold.

Defined results: null and short contents belong to no group; the empty table has no groups; records delivered twice are
one record; very long contents are compared whole; records without an id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.fingerprints import ball_keys, code_points, gram_hashes, min_symbols, mix
from terrane.operators.components import connected_components
from terrane.runtime import materialize, spread

GRAM, SIMILARITY, SHORTEST = 5, 0.65, 100
WIDTH, TABLES = 8, 28
#: Symbols of what a record holds beyond a pivot; symbols of a sketch that must agree (0.47 estimated, 4 deviations below 0.65).
BEYOND, SKETCH, AGREE = 16, 128, 64
#: Pivots of a variant by its records: PIVOTS where all pairs are as many, fewer beyond, at least one.
PIVOTS, SPENT = 3, 24
#: Bits (as a power of two) of the bitmap of ids whose texts are wanted: 2 MB.
FILTER = 24
#: Records of a batch that share a variant from which only pivots are sent on.
HOT = 64
#: Entries of a packed block; characters and texts hashed at once.
BLOCK, CHARS, TEXTS = 1 << 20, 2_000_000, 20_000
#: A group is paired in parts of this many records.
PART = 5000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def similarity(a: str, b: str, n: int = GRAM) -> float:
    """Shared distinct n-character substrings over those in either; equal texts have 1."""
    x, y = {a[i : i + n] for i in range(len(a) - n + 1)}, {b[i : i + n] for i in range(len(b) - n + 1)}
    either = len(x | y)
    return len(x & y) / either if either else float(a == b)


def contents(sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(uid, content) of all sources: uid = id * number of sources + index of the source."""
    k, out = len(sources), None
    for i, (df, key, text) in enumerate(sources):
        # a text too short before normalising stays too short
        part = df.select((F.col(key) * k + i).cast("bigint").alias("uid"), F.col(text).alias("content")).where(F.col(key).isNotNull() & (F.length(text) >= SHORTEST))
        out = part if out is None else out.unionByName(part)
    return out


def _chunks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > CHARS or i - start >= TEXTS):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _pack(key: np.ndarray, size: np.ndarray, uid: np.ndarray) -> bytes:
    """Low 32 bits of ascending keys as differences, sizes and ids, byte plane by byte plane, compressed."""
    k = np.diff(key & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    u = uid.astype("<u8").view(np.uint8).reshape(-1, 8).T
    raw = np.concatenate([k, size.astype(np.uint8)[None], u]).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8).reshape(13, -1)
    key = np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.uint64)
    return key, planes[4], np.ascontiguousarray(planes[5:].T).view("<i8").ravel()


def _sizes(texts: list[str]) -> np.ndarray:
    """Length in steps of a fifth, a byte."""
    return np.array([min(255, int(4 * math.log2(max(1, len(t))))) for t in texts], np.uint8)


def _runs(key: np.ndarray, size: np.ndarray, uid: np.ndarray):
    """Runs of equal keys with their shortest records first: (key, size, uid, start, length, place in the run)."""
    o = np.argsort(key)
    key, size, uid = key[o], size[o], uid[o]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(key)))
    several = np.repeat(length > 1, length)
    if several.any():  # only these need an order
        at = np.flatnonzero(several)
        at_sorted = at[np.lexsort((uid[at], size[at], key[at]))]
        size[at], uid[at] = size[at_sorted], uid[at_sorted]
    return key, size, uid, start, length, np.arange(len(key)) - np.repeat(start, length)


def _pivots(length: np.ndarray) -> np.ndarray:
    return np.clip(SPENT // np.maximum(length, 1), 1, PIVOTS)


_PACKED = "block bigint, kind tinyint, data binary"
_MET = "key bigint, a bigint, b bigint"
_ENTRIES, _HOT_KEYS, _MEMBERS = 0, 1, 2


def _rows(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _packets(key: np.ndarray, size: np.ndarray, uid: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """The entries of a batch, a packet a block; of hot keys the pivots only, and their members beside them."""
    block = (key >> np.uint64(32)) % np.uint64(blocks)
    key, size, uid, start, length, place = _runs((block << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF)), size, uid)
    out: list[tuple[int, int, bytes]] = []
    hot = np.repeat(length > HOT, length)
    if hot.any():
        out += [(int(k >> np.uint64(32)), _HOT_KEYS, k.tobytes()) for k in key[start[length > HOT]]]
        # members go anywhere, they wait for the pivots of all batches
        out.append((int(uid[0]), _MEMBERS, np.stack([key[hot].astype(np.int64), uid[hot]]).tobytes()))
        keep = ~hot | (place < PIVOTS)
        key, size, uid = key[keep], size[keep], uid[keep]
    block = (key >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])) if len(key) else np.zeros(0, np.int64)
    for s, e in zip(edge, np.append(edge[1:], len(key))):
        out.append((int(block[s]), _ENTRIES, _pack(key[s:e], size[s:e], uid[s:e])))
    if out:
        n, k, d = zip(*out)
        yield _rows({"block": (n, pa.int64()), "kind": (k, pa.int8()), "data": (d, pa.binary())})


def _emit(blocks: int, sources: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normal(t) for t in b.column(1).to_pylist()]
            ok = np.array([len(t) >= SHORTEST for t in texts], bool)
            texts, uids = [t for t in texts if len(t) >= SHORTEST], b.column(0).to_numpy(zero_copy_only=False)[ok]
            if not texts:
                continue
            keys = np.concatenate([ball_keys(*min_symbols(texts[s], GRAM, WIDTH * TABLES), TABLES, WIDTH) for s in _chunks(texts)])
            with np.errstate(over="ignore"):
                keys = mix(keys + ((uids % sources).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
            n = keys.shape[1]
            yield from _packets(keys.ravel(), np.repeat(_sizes(texts), n), np.repeat(uids, n), blocks)

    return run


def _emit_beyond(blocks: int):
    """Keys of what records hold beyond a pivot: every symbol, fixed twos and fixed fours of them, within the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pivot, uid, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            s = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u4").reshape(-1, BEYOND).astype(np.uint64)
            with np.errstate(over="ignore"):
                place = mix(np.arange(1, BEYOND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                one = np.where(s != 0, mix(s * np.uint64(0x94D049BB133111EB) + place), np.uint64(0))
                groups = [one]
                for k in (2, 4):
                    part = one.reshape(len(one), k, -1)
                    groups.append(np.where((part != 0).all(1), mix(part.sum(1, dtype=np.uint64) + np.uint64(k)), np.uint64(0)))
                keys = np.concatenate(groups, axis=1)
                there = keys != 0
                keys = mix(keys + mix(pivot.astype(np.uint64) + np.uint64(1))[:, None])
            row = np.repeat(np.arange(len(uid)), keys.shape[1])[there.ravel()]
            yield from _packets(keys.ravel()[there.ravel()], size.astype(np.uint8)[row], uid[row], blocks)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key null) of records with their pivots, and the pivots (b null) and members (a null) of hot keys."""
    held: dict[int, list] = {}
    hot: dict[int, set] = {}

    def table(key, a, b):
        n = len(a if a is not None else b)
        return _rows({k: (pa.nulls(n, pa.int64()) if v is None else v, pa.int64()) for k, v in (("key", key), ("a", a), ("b", b))})

    for batch in batches:
        for n, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == _MEMBERS:
                key, uid = np.frombuffer(data, "<i8").reshape(2, -1)
                yield table(key, None, uid)
            elif kind == _HOT_KEYS:
                hot.setdefault(n, set()).add(int(np.frombuffer(data, "<i8")[0]))
            else:
                held.setdefault(n, []).append(data)
    for n in list(held):
        key, size, uid, start, length, place = _runs(*(np.concatenate(x) for x in zip(*map(_unpack, held.pop(n)))))
        run = np.repeat(np.arange(len(start)), length)
        for p in range(PIVOTS):
            at = np.flatnonzero((place > p) & (_pivots(length)[run] > p))
            if len(at):
                a, b = uid[start[run[at]] + p], uid[at]
                yield table(None, a[a != b], b[a != b])
        known = np.array(sorted(hot.get(n, ())), np.int64)
        if len(known):
            at = np.flatnonzero(np.isin(key.astype(np.int64) + (n << 32), known) & (place == 0))
            yield table(key[at].astype(np.int64) + (n << 32), uid[at], None)


def met_pairs(packed: DataFrame, parts: int) -> DataFrame:
    """(a, b): every record beside the pivots of the variants it shares with others, a the pivot."""
    met = materialize(packed.repartition(parts, "block").mapInArrow(_meet, _MET), "met")
    pivots, members = met.where("key is not null and b is null"), met.where("key is not null and a is null")
    hot = members.select("key", "b").join(pivots.select("key", "a"), "key").select("a", "b").where("a <> b")
    return met.where("key is null").select("a", "b").unionByName(hot).distinct()


_WORDS = [f"s{i}" for i in range(SKETCH // 16)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and sketch of every content that is long enough."""
    for b in batches:
        texts = [normal(t) for t in b.column(1).to_pylist()]
        ok = np.array([len(t) >= SHORTEST for t in texts], bool)
        texts = [t for t in texts if len(t) >= SHORTEST]
        d = [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
        parts = [min_symbols(texts[s], GRAM, SKETCH)[0] >> np.uint64(60) for s in _chunks(texts)]
        words = np.concatenate([*parts, np.zeros((0, SKETCH), np.uint64)]).reshape(-1, SKETCH // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
        words = np.bitwise_or.reduce(words, axis=2).view(np.int64)
        halves = {"d1": [(x >> 64) - (1 << 63) for x in d], "d2": [(x & ((1 << 64) - 1)) - (1 << 63) for x in d]}
        yield _rows({"uid": (b.column(0).to_numpy(zero_copy_only=False)[ok], pa.int64()), **{k: (v, pa.int64()) for k, v in halves.items()}, **{k: (words[:, i], pa.int64()) for i, k in enumerate(_WORDS)}})


def _agree() -> str:
    """SQL: the number of four-bit symbols in which the sketches p and q agree."""
    x = [f"(p.{k} ^ q.{k})" for k in _WORDS]
    return " + ".join(f"(16 - bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & 1229782938247303441L))" for v in x)


def _bits(uid: np.ndarray) -> np.ndarray:
    return (mix(uid.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - FILTER)).astype(np.int64)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bit = np.unique(_bits(b.column(0).to_numpy(zero_copy_only=False)))
        yield _rows({"word": (bit >> 6, pa.int64()), "bits": (np.int64(1) << (bit & 63), pa.int64())})


def _filtered(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            bit = _bits(b.column(0).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array((words[bit >> 6] >> (bit & 63)) & 1 == 1))

    return run


def needed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, content) of all ends of the pairs, once each. A bitmap of fixed size (2 ** FILTER bits) keeps most other texts
    out of the shuffle while the ends are few; it never loses one."""
    spark = pairs.sparkSession
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid")))
    words = np.zeros(1 << (FILTER - 6), np.int64)
    for w, bits in ends.mapInArrow(_filter_words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits")).collect():
        words[w] = bits
    slim = texts.select("uid", "content").mapInArrow(_filtered(spark.sparkContext.broadcast(words)), "uid bigint, content string")
    return slim.join(ends.distinct(), "uid", "left_semi").dropDuplicates(["uid"])


def alike(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in AGREE symbols or more."""
    both = pairs.join(sketched.withColumnRenamed("uid", "b").alias("q"), "b").join(sketched.withColumnRenamed("uid", "a").alias("p"), "a")
    return both.where(F.expr(_agree()) >= AGREE).select("a", "b")


def _verify(least: float, beyond: bool):
    def grams(t: str) -> np.ndarray:
        return np.unique(gram_hashes(code_points(t), GRAM))

    def symbols(h: np.ndarray, pivot: int) -> bytes:
        """The least of the hashes in each of BEYOND bins, in 32 bits; 0 where a bin is empty. Every pivot has hashes of
        its own, so records with several pivots in common have as many chances more."""
        out = np.zeros(BEYOND, "<u4")
        h = np.sort(mix(h ^ mix(np.array([pivot + 1], np.int64).view(np.uint64))))
        slot = (h >> np.uint64(60)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(h) else np.zeros(0, np.int64)
        out[slot[first]] = (h[first] >> np.uint64(28)).astype(np.uint32) | np.uint32(1)
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            sims, sizes, rest = [], [], []
            for a, s, t in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if a != last:
                    last, x = a, grams(normal(s))
                t = normal(t)
                y = grams(t)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(shared / max(1, len(x) + len(y) - shared))
                wanted = beyond and sims[-1] < least
                sizes.append(int(_sizes([t])[0]) if wanted else None)
                rest.append(symbols(np.setdiff1d(y, x, assume_unique=True), a) if wanted else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64()), pa.array(sizes, pa.int32()), pa.array(rest, pa.binary())], ["a", "b", "similarity", "size", "rest"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, beyond: bool = False) -> DataFrame:
    """(a, b, similarity, size, rest) of every candidate pair, by the exact measure; size and rest describe what b holds
    beyond a where the pair is no link."""
    # texts of pivots with many partners: AQE splits the pairs and repeats the text
    both = pairs.join(texts.select(F.col("uid").alias("b"), F.col("content").alias("tb")), "b").join(texts.select(F.col("uid").alias("a"), F.col("content").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(least, beyond), "a bigint, b bigint, similarity double, size int, rest binary")


def _shape(df: DataFrame, entries: int) -> tuple[int, int]:
    """(blocks, partitions) for so many entries."""
    blocks = max(64, -(-entries // BLOCK))
    return blocks, max(df.sparkSession.sparkContext.defaultParallelism * 2, blocks // 8)


def links_of(reps: DataFrame, sketched: DataFrame, n: int, sources: int, least: float) -> DataFrame:
    """(a, b, similarity): the links met among n different contents (uid, content)."""
    blocks, parts = _shape(reps, n * TABLES * (WIDTH + 1))
    star = materialize(met_pairs(reps.mapInArrow(_emit(blocks, sources), _PACKED), parts), "pairs")
    pairs = materialize(alike(star, sketched), "pairs")
    texts = materialize(needed(pairs, reps), "texts")
    first = materialize(verified(pairs, texts, least, True), "tested")
    rest = first.where("rest is not null").select("a", "b", "size", "rest")
    blocks, parts = _shape(reps, rest.count() * BEYOND * 7 // 4)
    found = met_pairs(rest.mapInArrow(_emit_beyond(blocks), _PACKED), parts)
    # either end may be the pivot of a pair
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = materialize(alike(found.select(*ordered).distinct().join(first.select(*ordered), ["a", "b"], "left_anti"), sketched), "pairs")
    second = verified(pairs, texts, least)
    return first.unionByName(second).where(F.col("similarity") >= least).select(*ordered, "similarity").dropDuplicates(["a", "b"])


def _found(sources: list[tuple[DataFrame, str, str]], least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(groups, links met so far, copies with their representative, contents)."""
    k = len(sources)
    docs = spread(contents(sources), "uid")
    schema = ", ".join(f"{c} bigint" for c in ("uid", "d1", "d2", *_WORDS))
    digests = materialize(docs.mapInArrow(_digests, schema).dropDuplicates(["uid"]), "digests")
    n = digests.count()
    same = ["d1", "d2", F.pmod(F.col("uid"), F.lit(k)).alias("src")]
    firsts = digests.groupBy(*same).agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(digests.drop(*_WORDS).withColumn("src", F.pmod(F.col("uid"), F.lit(k))).join(firsts.drop("n"), ["d1", "d2", "src"]).where("uid <> rep").select("uid", "rep"), "copies")
    # a record delivered twice stays twice here and meets itself, which makes no pair
    reps = docs.join(copies.select("uid"), "uid", "left_anti")
    close = materialize(links_of(reps, digests.select("uid", *_WORDS), n, k, least), "links")
    edges = close.select("a", "b").unionByName(copies.select(F.col("uid").alias("a"), F.col("rep").alias("b")))
    groups = connected_components(edges).select(F.col("id").alias("uid"), F.col("component").alias("group_id"))
    return groups, close, copies, docs


def _all_links(groups: DataFrame, met: DataFrame, copies: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The links met so far and those among the other pairs of different contents within a group."""
    others = materialize(group_pairs(groups.join(copies.select("uid"), "uid", "left_anti")).join(met.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = verified(others, materialize(needed(others, docs), "texts"), least).where(F.col("similarity") >= least)
    return met.unionByName(more.select("a", "b", "similarity"))


def grouped(sources: list[tuple[DataFrame, str, str]], least: float = SIMILARITY) -> DataFrame:
    """(uid, group_id) of every record that has a partner."""
    return _found(sources, least)[0]


def near_duplicates(sources: list[tuple[DataFrame, str, str]], least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(groups, links): groups has (uid, group_id) of every record that has a partner, links (a, b, similarity) all links
    between different contents of a group; equal contents are in one group and not repeated in links."""
    groups, met, copies, docs = _found(sources, least)
    groups = materialize(groups, "groups")
    return groups, _all_links(groups, met, copies, docs, least)


def counted(sources: list[tuple[DataFrame, str, str]], least: float = SIMILARITY) -> DataFrame:
    """(uid, group_id, n_links) of every record that has a partner: its links to other contents, copies having those of
    their representative."""
    groups, met, copies, docs = _found(sources, least)
    groups = materialize(groups, "groups")
    links = _all_links(groups, met, copies, docs, least)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    g = groups.join(copies, "uid", "left").withColumn("rep", F.coalesce("rep", "uid")).join(ends, "rep", "left")
    return g.select("uid", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs within each group; a large group is paired in parts."""
    sizes = groups.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    g = groups.join(sizes, "group_id")
    x = g.select("group_id", F.col("uid").alias("a"), F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"))
    y = g.select("group_id", F.col("uid").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return x.join(y, ["group_id", "part"]).where("a < b").select("a", "b")
