"""Mixing sources to target weights: a low-discrepancy source schedule.

Sizes are tokens of a public tokenizer over the whole text. The mix is as large as the scarcest source allows: no source
needs more than its cap of repeats. Within a source, documents are shuffled by a hash, repeated pass by pass up to the
source's budget, and cut into blocks of equal tokens; golden-ratio points through the cumulative weights give each slot
of the schedule its source, and the n-th slot of a source takes its n-th block.

Running sums are taken in two levels: documents fall into BUCKETS buckets of their shuffle order a source, sums of
buckets are accumulated on a table of sources times buckets rows, and only then do rows within a bucket get theirs. A
source with a third of all documents is spread over its buckets.

Defined results: null, empty and unknown sources and documents without a text or id are not mixed; source names are
compared in lower case and trimmed; a source with a target but no documents reaches nothing and does not bound the mix;
targets that are null, zero or negative ask for nothing, a null cap allows one use; repeated target rows count once;
a document longer than a block fills the block it begins in; an empty table gives an empty mix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.runtime import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, BUCKETS = 8192, 256
#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def clean(name) -> F.Column:
    return F.lower(F.trim(name))


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) with the clean name of the source."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean(F.col("source")).alias("source"), "text").where("doc_id is not null and source <> '' and length(text) > 0")
    return spread(docs, "doc_id").mapInArrow(_count(tokenizer), "doc_id bigint, source string, tokens bigint")


def plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """Per source its weight, cap, tokens and budget. Sources are few: one row each."""
    want = {}
    for r in targets.select(clean(F.col("source")).alias("source"), "target_share", "max_repeat").collect():
        if r[0] and r[1] and r[1] > 0:
            want[r[0]] = (float(r[1]), max(1, int(r[2] or 1)))
    have = dict(sizes.where(F.col("source").isin(list(want)) if want else F.lit(False)).groupBy("source").agg(F.sum("tokens")).collect())
    whole = sum(share for share, _ in want.values()) or 1.0
    rows = [{"source": s, "share": share / whole, "target_share": share, "cap": cap, "tokens": int(have.get(s, 0) or 0)} for s, (share, cap) in sorted(want.items())]
    total = min((r["cap"] * r["tokens"] / r["share"] for r in rows if r["tokens"]), default=0)
    for r in rows:
        r["budget"] = int(total * r["share"]) if r["tokens"] else 0
    return rows


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over the rows of the same keys that come earlier by (bucket, order)."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("w"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("offset"))
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(offsets, [*keys, bucket]).withColumn(name, F.col("offset") + F.coalesce(F.sum(value).over(local), F.lit(0))).drop("offset")


def _copies(sizes: DataFrame, rows: list[dict], seed: int) -> DataFrame:
    """Every use of every document within the budgets: (source, doc_id, copy, tokens, before)."""
    spark = sizes.sparkSession
    used = [r for r in rows if r["budget"] > 0]
    info = F.broadcast(spark.createDataFrame([(r["source"], r["tokens"], r["budget"]) for r in used], "source string, total bigint, budget bigint"))
    hashed = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int"))
    placed = _running(hashed.join(info, "source"), ["source"], "bucket", ["h", "doc_id"], "tokens", "first")
    # pass p of a source begins at p times its tokens; a use counts if its middle lies within the budget
    passes = F.floor((F.col("budget") - F.col("first") - F.col("tokens") / 2) / F.col("total"))
    return placed.withColumn("passes", passes).where("passes >= 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes")))).select("source", "doc_id", F.col("copy").cast("int").alias("copy"), "tokens", (F.col("first") + F.col("copy") * F.col("total")).alias("before"))


def _schedule(spark, rows: list[dict], block: int) -> DataFrame:
    """(source, block_no, slot): the n-th slot of a source in the golden-ratio sequence."""
    used = [r for r in rows if r["budget"] > 0]
    slots = sum(-(-r["budget"] // block) for r in used)
    weight = sum(r["budget"] for r in used)
    point = F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)")
    case, upto = None, 0.0
    for r in used[:-1]:
        upto += r["budget"] / weight
        case = F.when(F.col("x") < upto, r["source"]) if case is None else case.when(F.col("x") < upto, r["source"])
    last = F.lit(used[-1]["source"])
    s = spark.range(slots).withColumn("x", point).select(F.col("id").alias("slot"), (case.otherwise(last) if case is not None else last).alias("source"))
    s = s.withColumn("bucket", F.shiftrightunsigned("slot", 14)).withColumn("one", F.lit(1))
    return _running(s, ["source"], "bucket", ["slot"], "one", "block_no").select("source", F.col("block_no").cast("bigint").alias("block_no"), "slot")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: (slot, source, doc_id, copy, tokens) in the order of slot, a hash within it; a block for which the
    sequence has no slot shares one where its place in its source falls. shares: one row per target source with its share asked for and
    really reached, its tokens in the mix and its greatest number of uses of a document.
    """
    spark = documents.sparkSession
    sizes = materialize(sized(documents, tokenizer), "sizes")
    rows = plan(sizes, targets)
    if not any(r["budget"] > 0 for r in rows):
        return spark.createDataFrame([], "slot bigint, source string, doc_id bigint, copy int, tokens bigint"), _shares(spark, rows, None)
    copies = materialize(_copies(sizes, rows, seed), "copies")
    blocks = copies.withColumn("block_no", F.floor(F.col("before") / block))
    slots = sum(-(-r["budget"] // block) for r in rows)
    schedule = _schedule(spark, rows, block)
    # the sequence gives a source a few slots more or less than it has blocks; those left over stand where their share has them
    need = F.create_map(*[F.lit(x) for r in rows if r["budget"] > 0 for x in (r["source"], -(-r["budget"] // block))])
    spare = F.least(F.floor((F.col("block_no") + 0.5) / need[F.col("source")] * slots), F.lit(slots - 1)).cast("bigint")
    mixed = blocks.join(schedule, ["source", "block_no"], "left").select(F.coalesce("slot", spare).alias("slot"), "source", "doc_id", "copy", "tokens")
    return mixed, _shares(spark, rows, copies)


def _shares(spark, rows: list[dict], copies: DataFrame | None) -> DataFrame:
    plan_ = spark.createDataFrame([(r["source"], r["target_share"], r["cap"], r["tokens"]) for r in rows], "source string, target_share double, max_repeat int, available_tokens bigint")
    if copies is None:
        zero = F.lit(0).cast("bigint")
        return plan_.select("*", zero.alias("mixed_tokens"), zero.alias("mixed_documents"), F.lit(0).alias("used_repeat"), F.lit(0.0).alias("actual_share"))
    got = copies.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_documents"), (F.max("copy") + 1).alias("used_repeat"))
    out = plan_.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents", "used_repeat"])
    whole = Window.partitionBy()  # one row a source
    return out.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.sum("mixed_tokens").over(whole), 6))
