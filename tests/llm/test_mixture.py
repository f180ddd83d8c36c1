import tiktoken

from terrane.llm.mixture import PATTERN, TOKENIZER, mix


def test_shares_caps_and_nulls(spark):
    docs = [(i, "alpha beta gamma delta " * 5 + str(i), [" Big", "small", "mid"][0 if i % 10 < 7 else 1 if i % 10 == 7 else 2], "z", 1) for i in range(3000)]
    docs += [(9001, None, "big", "z", 1), (9002, "x", None, "z", 1), (9003, "x y", "other", "z", 1), (None, "x", "big", "z", 1), (9004, "", "big", "z", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, bucket string, tokens int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 2), ("absent", 0.1, 2), (None, 0.1, 1), ("bad", None, 1)], "source string, target_share double, max_repeat int")
    mixed, shares = mix(d, t, block=256)
    m = mixed.toPandas()
    s = {r.source: r for r in shares.collect()}
    assert not m.duplicated(["doc_id", "copy"]).any() and m.doc_id.max() < 9000
    assert (m.groupby(["source", "doc_id"]).size().groupby("source").max() <= [1, 2, 3]).all()
    for name, want in (("big", 0.5), ("small", 0.3), ("mid", 0.2)):
        assert abs(s[name].actual_share - want) < 0.01
    assert s["absent"].mixed_tokens == 0 and s["small"].used_repeat == 3
    head = m.sort_values("slot").head(len(m) // 4)
    assert abs(head[head.source == "small"].tokens.sum() / head.tokens.sum() - 0.3) < 0.05
    assert mix(d, t, block=256)[0].orderBy("slot", "doc_id", "copy").collect() == mixed.orderBy("slot", "doc_id", "copy").collect()


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    mixed, shares = mix(d, t)
    assert mixed.count() == 0 and shares.first().actual_share == 0
    assert mix(d, t.limit(0))[1].count() == 0


def test_pattern_is_the_public_one():
    import base64

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert enc.decode(enc.encode_ordinary("It's 12 fine—是的\n\n ok")) == "It's 12 fine—是的\n\n ok"
