import random

from terrane.llm.chunking import boundaries, code_points, cut_kind, cuts, split_items


def text(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 9))) + r.choice(["", "", ".", "!", "。", "\n"]) for _ in range(n))


def check(t, size=1000, overlap=50):
    c, natural = cuts(t, size, overlap, 400), set(boundaries(code_points(t)).tolist())
    done = 0
    for s, e, kind in c:
        assert 0 < e - s <= size and s <= done and done - s <= overlap
        if kind == "natural":
            assert e in natural
        if kind == "forced":
            assert not any(done < b <= done + size for b in natural)
        if kind != "end" or len(c) > 1:
            assert e > done
        done = e
    assert done == len(t)
    ends = sorted(natural | {0, len(t)})
    gap = max(b - a for a, b in zip(ends, ends[1:]))
    assert any(k == "forced" for _, _, k in c) == (gap > size)
    return c


def test_pieces_cover_the_text_and_cut_at_boundaries():
    for seed in range(30):
        check(text(600, seed))
    check("x" * 5000)
    check("x" * 990 + "\n" + "y" * 980 + "\n" + "z" * 700)
    check("文" * 1500 + "。" + "字" * 400)


def test_edit_moves_neighbouring_cuts_only():
    t = text(3000, 5)
    a = {e for _, e, _ in cuts(t)}
    u = t[:6000] + "inserted words here. " + t[6000:]
    b = {e for _, e, _ in cuts(u)}
    moved = {e + 21 for e in a if e > 8500}
    assert len(moved - b) <= 3 and {e for e in a if e < 5000} <= b


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    long, run = text(500, 3), "x" * 1200
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, None, "b"), (3, "", "c"), (4, "short", "d"), (None, long, "e"), (5, run, "f")], "k long, t string, piece string")
    p = split_items(df, "k", "t")
    rows = p.orderBy("item_id", "piece_no").collect()
    own = [r for r in rows if r.item_id == 1]
    assert [r.piece_no for r in own] == list(range(1, len(own) + 1))
    assert "".join(r.piece[r.overlap :] for r in own) == long
    assert {(r.item_id, r.cut) for r in cut_kind(p).collect()} == {(1, "natural"), (5, "forced")}
    assert split_items(df.limit(0), "k", "t").count() == 0
