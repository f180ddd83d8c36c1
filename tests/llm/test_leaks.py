import numpy as np

from terrane.llm.leaks import RUN, common, leaks, longest_run, reduced, run_hashes

P = "The council of Anori gathered for seven long days before the ledger of Belimo was sealed by the keeper of Tarn."
Z = "安诺里议会在贝利莫账册封存之前集结了七天，只有塔恩的守卫保存着钥匙，并且每个夜晚都要清点所有的箱子和陶罐，直到黎明来临为止。"


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "c", 1.0) for x in docs], "doc_id long, text string, item_id string, run double")
    i = spark.createDataFrame(items, "item_id long, passage string, answer string")
    return leaks(d, i)


def test_every_shared_run_is_found(spark):
    short = "gathered for seven long days before the ledger of Belimo"
    docs = [(1, "xx " + P + " yy"), (2, "before " + short.upper() + " after " * 400), (3, "nothing here at all, only words"), (4, None), (5, ""), (6, Z[5:60]), (7, "g a t h e r e d for seven long days"), (8, "q " * 30000 + P), (1, "xx " + P + " yy"), (None, P)]
    got = {(x.doc_id, x.item_id) for x in run(spark, docs, [(10, P, "seven long days"), (11, Z, "七天"), (12, None, "x"), (None, P, "x"), (13, "tiny", "t")]).where(f"run >= {RUN}").collect()}
    assert got == {(1, 10), (2, 10), (6, 11), (8, 10)}


def test_paraphrase_needs_the_answer(spark):
    para = P.replace("gathered", "met").replace("ledger", "books").replace("long ", "long, long ").replace("keeper", "warden")
    got = run(spark, [(1, para)], [(10, P, "Belimo")]).collect()
    assert [(x.doc_id, x.run, x.answer) for x in got] == [(1, 0, True)] or got[0].run >= RUN
    assert run(spark, [(1, para)], [(10, P, "not in there")]).where("run = 0").count() == 0


def test_empty_tables(spark):
    assert run(spark, [], [(10, P, "a")]).count() == 0
    assert run(spark, [(1, P)], []).count() == 0


def test_runs_and_subsequences():
    assert common("abcde", "axcye") == 3 and common("", "a") == 0
    a, _ = reduced(["A-b c1!" * 20])
    assert "".join(map(chr, a[:4])) == "abc1"
    r = np.random.default_rng(1)
    for n in (0, 39, 40, 75):
        x, y = (r.integers(97, 123, 300).astype(np.uint32) for _ in range(2))
        y[20 : 20 + n] = x[100 : 100 + n]
        x[99], y[19], x[100 + n], y[20 + n] = 1, 2, 3, 4
        assert longest_run(x, y, run_hashes(x), np.unique(run_hashes(y))) == (n if n >= RUN else 0)


def test_shared_runs_do_not_depend_on_the_cosine(spark):
    # the run's grams are in many documents, those around it are rare; and a run of few distinct grams
    r = np.random.default_rng(2)
    rare = ["".join(map(chr, r.integers(97, 123, 300))) for _ in range(3)]
    run_text = "thekeeperofthetarncountsthechestsatnightx"[:RUN]
    a, b, c = rare[0][:140] + run_text + rare[0][140:], rare[1], "xy" * 30 + rare[2]
    docs = [(i, "0" * 100 + run_text + "0" * 100) for i in range(60)]
    docs += [(100, b[:90] + run_text + b[90:180]), (101, "zq" * 50 + "xy" * 20 + "zq" * 50), (102, run_text[:-1]), (103, run_text[1:])]
    found = run(spark, docs, [(10, a, "no"), (11, b, "no"), (12, c, "no")]).where(f"run >= {RUN}")
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got == {(i, 10) for i in range(60)} | {(100, 10), (100, 11), (101, 12)}
