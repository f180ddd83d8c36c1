import numpy as np
import pyarrow as pa

from terrane.llm import answers as A
from terrane.llm.answers import DEFECTS, VALIDATION, Evidence, all_votes, defects, evidence, language, main_defect

#: (question, answer, truth, defects): the cutoffs never see these.
HELD = [
    ("Where is the key of the archive?", ["No comment."], None, {"refusal"}),
    ("What does the letter say?", ["I cannot read that message."], None, {"refusal"}),
    ("Which rows were deleted?", ["I can't show that."], None, {"refusal"}),
    ("Which rows were deleted?", ["Lo siento, no puedo ayudarle con esa consulta."], None, {"refusal", "other_language"}),
    ("Which rows were deleted?", ["That is confidential and will not be shared."], None, {"refusal"}),
    ("Who may open the vault?", ["As an AI assistant, I'm not able to discuss that."], ["The keeper may open it."], {"refusal"}),
    ("谁可以打开仓库？", ["不好意思，我不能透露。"], None, {"refusal"}),
    ("Wer darf das Lager öffnen?", ["Das darf ich nicht verraten."], None, {"refusal"}),
    ("Qui peut ouvrir le dépôt ?", ["Je refuse de répondre à cette question."], None, {"refusal"}),
    ("Why did the upload fail?", ["The client displays: I am unable to connect.", "The proxy was down during the upload."], None, set()),
    ("Why did the upload fail?", ["Guests cannot write to the folder."], ["Guests cannot write to the folder."], set()),
    ("上传为什么失败？", ["没有权限的访客不能写入该文件夹。"], None, set()),
    ("Warum schlug der Upload fehl?", ["Gäste können nicht in den Ordner schreiben."], None, set()),
    ("Which rows were deleted?", ["Las filas antiguas fueron borradas por el administrador durante la noche del lunes."], None, {"other_language"}),
    ("Which rows were deleted?", ["Le righe vecchie sono state cancellate dal gestore durante la notte di lunedì."], None, {"other_language"}),
    ("Which rows were deleted?", ["古い行は月曜日の夜に削除されました。"], None, {"other_language"}),
    ("Welche Zeilen wurden gelöscht?", ["The old rows were removed by the keeper on Monday night."], None, {"other_language"}),
    ("Quelles lignes ont été supprimées ?", ["Die alten Zeilen hat der Verwalter am Montag in der Nacht entfernt."], None, {"other_language"}),
    ("哪些行被删除了？", ["The old rows were removed by the keeper on Monday night."], None, {"other_language"}),
    ("Please translate 'old rows' into German.", ["alte Zeilen"], None, set()),
    ("Which rows were deleted?", ["The old ones, by the keeper, on Monday night."], None, set()),
    ("Which file is open?", ["`config.toml`"], None, set()),
    ("Which city is meant?", ["Zürich"], None, set()),
    ("How long does it take?", ["3.5 hours"], None, set()),
    ("Is it safe?", ["Yes"], None, set()),
    ("安全吗？", ["不是"], None, set()),
    ("Which rows were deleted?", ["WHICH ROWS WERE DELETED"], None, {"copied_question"}),
    ("Which rows were deleted?", ["Question: Which rows were deleted?", "Which rows were deleted?"], None, {"copied_question"}),
    ("哪些行被删除了？", ["问：哪些行被删除了"], None, {"copied_question"}),
    ("Which rows were deleted?", ["Which rows were deleted? The old ones were."], None, set()),
    ("Which rows were deleted?", ["N/A"], None, {"empty"}),
    ("Which rows were deleted?", ["---", "  "], None, {"empty"}),
    ("Which rows were deleted?", [], None, {"empty"}),
    ("哪些行被删除了？", ["不适用"], None, {"empty"}),
    ("Which rows were deleted?", ["The old rows were removed by the keeper because"], None, {"truncated"}),
    ("Which rows were deleted?", ["The old rows were removed by the"], None, {"truncated"}),
    ("Which rows were deleted?", ["The old rows were rem"], ["The old rows were removed by the keeper."], {"truncated"}),
    ("How do I delete rows?", ["Use this:", "```sql\nDELETE FROM rows WHERE"], None, {"truncated"}),
    ("How do I delete rows?", ["There are two ways:", "1. Ask the keeper.", "2."], None, {"truncated"}),
    ("哪些行被删除了？", ["管理员在周一夜里删除了旧的行，并且"], None, {"truncated"}),
    ("Welche Zeilen wurden gelöscht?", ["Die alten Zeilen wurden entfernt, weil der"], None, {"truncated"}),
    ("How do I delete rows?", ["Use `DELETE FROM rows`."], None, set()),
    ("How do I delete rows?", ["Ask the keeper, then wait for the night."], None, set()),
    ("Which parts are kept?", ["headers, footers and page numbers"], None, set()),
]


def frame(spark, pairs):
    return spark.createDataFrame([(*x, "x") for x in pairs], "pair_id long, question string, answer array<string>, ground_truth array<string>, defect string")


def test_defects_of_labelled_pairs(spark):
    pairs = [(i, q, a, t) for i, (q, a, t, _) in enumerate(VALIDATION)] * 2
    more = [("Why is Anori slow in the night?", [f"Anori waits for the lock number {n} of the table."], [f"Anori waits for the lock number {n} of the table."]) for n in range(60)]
    pairs += [(100 + n, *x) for n, x in enumerate(more)]
    pairs += [(900, None, ["Anori keeps all of its rows."], None), (901, "Why?", [None], None), (902, None, None, None), (None, "Why?", ["x"], None), (903, "How long?", ["Anori waits. " * 20000], None)]
    found = defects(frame(spark, pairs))
    got = {(r.pair_id, r.defect) for r in found.collect() if r.pair_id < 100}
    want = {(i, d) for i, (_, _, _, ds) in enumerate(VALIDATION) for d in ds}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 1, (want - got, got - want)
    rest = {(r.pair_id, r.defect) for r in main_defect(found).where("pair_id >= 100").collect()}
    assert rest == {(901, "empty"), (902, "empty")}
    assert main_defect(found).count() == main_defect(found).select("pair_id").distinct().count()


def test_held_out_pairs(spark):
    # votes of the test table fit the model, the held-out pairs only ask it
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/correctness_classifier.parquet").select("pair_id", "question", "answer", "ground_truth")
    held = spark.createDataFrame([(-1 - i, q, a, t) for i, (q, a, t, _) in enumerate(HELD)], table.schema)
    found = defects(table.unionByName(held), spark.read.parquet(f"{d}/documents.parquet"))
    got = {(-1 - r.pair_id, r.defect) for r in found.where("pair_id < 0").collect()}
    want = {(i, d) for i, (_, _, _, ds) in enumerate(HELD) for d in ds}
    figures = {d: (len({i for i, x in want & got if x == d}), len({i for i, x in got if x == d}), len({i for i, x in want if x == d})) for d in DEFECTS}
    print(figures)
    wrong = [(HELD[i][:2], d, (i, d) in want) for i, d in want ^ got]
    assert len(want & got) >= 0.93 * len(want) and len(got - want) <= 2, (figures, wrong)
    assert all(hit >= 0.85 * true for hit, _, true in figures.values()), (figures, wrong)


def test_empty_table(spark):
    assert defects(frame(spark, [])).count() == 0


def test_language():
    assert [language(t) for t in ("The group of Anori is slow.", "Die Gruppe darf nicht warten.", "Le groupe peut ouvrir les pages.", "安诺里会清理页面。", "Anori-7", "No comment.", "これはペンです。", None)] == ["en", "de", "fr", "zh", None, None, "ja", None]
    v = all_votes([("Where is it?", ["No comment."], None)], Evidence())[0]
    assert "+" not in v["other_language"] and v["refusal"].startswith("+")


def test_models_count_every_row(spark):
    # what decides lies behind the first 4,000 statements and 2,000 texts
    said = [f"line {n} of the list is kept~" if n >= 4000 else f"line {n} of the list is kept." for n in range(5000)]
    pairs = frame(spark, [(n, "Which line?", ["1"], [t, None]) for n, t in enumerate(said)])
    texts = [("en", "The rows of the list are kept in the night.")] * 2500 + [("Sv-SE", "Raderna i listan sparas alltid under natten och städas sedan bort.")] * 9 + [("zh", "每晚清理页面。"), ("", "x"), (None, "y"), ("en", None)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    model = evidence(pairs.coalesce(1), docs.coalesce(1))
    assert "sv" in model.languages and "zh" not in model.languages
    grams = [f" {t} "[i : i + 4].casefold() for t in said for i in range(len(t) - 1)]
    one = next(iter(A.statement_counts(iter([pa.RecordBatch.from_arrays([pa.array(said)], ["t"])]))))
    assert sum(one["n"].to_pylist()) == len(grams)
    slot = lambda two: (ord(two[1]) * 31 + ord(two[0])) % 4096
    for end in ("t~", "t."):
        last = sum(slot(t[-2:]) == slot(end) for t in said)
        inner = sum(slot(t[i : i + 2]) == slot(end) for t in said for i in range(len(t) - 2))
        assert last in (1000, 4000) and abs(model.ends(end) - np.log((last + 0.5) / (inner + 0.5))) < 1e-9
    lead = model.leads(["Raderna sparas under natten"])[0]
    assert lead["sv"] == 0 and lead["en"] > A.LEAD
    # the order and number of parts and a second delivery change nothing, nor do pairs without an id
    again = evidence(pairs.union(pairs).union(frame(spark, [(None, "Which line?", ["1"], ["zzzz"])])).repartition(7), docs.repartition(5))
    assert again.languages == model.languages
    assert all(np.array_equal(getattr(again, k), getattr(model, k)) for k in ("profiles", "refusal", "ending"))


def test_counts_in_pieces(monkeypatch):
    texts = ["Der Dienst leert die Zeilen 12 und 7.", "", "ab", "İstanbul ß " * 50]
    whole = np.bincount(A._buckets([A._padded(t) for t in texts], 3, 15)[1], minlength=1 << 15)
    codes = [(a + b, "die zeilen bleiben.") for a in "bcdefghi" for b in "klmnopqrst"] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in codes]) for i in (0, 1)], ["lang", "text"])
    for piece, languages in ((1 << 14, 64), (7, 3)):
        monkeypatch.setattr(A, "PIECE", piece)
        monkeypatch.setattr(A, "LANGUAGES", languages)
        assert np.array_equal(A._counted(texts, 3, 15), whole)
        rows = [r for b in A.language_counts(iter([batch, batch])) for r in b.to_pylist()]
        assert sum(r["n"] for r in rows) == 2 * len(codes) * len("die zeilen bleiben.") and {r["model"] for r in rows} == {x[0] for x in codes}


def test_votes_do_not_depend_on_the_size_of_the_table():
    seen = {"en": A._counted(["The rows of the list are kept in the night."] * 9000, 3, 15), "+others": A._counted(["The rows are kept in the night."] * 12000, 4, 15)}
    more = {k: 1000 * n for k, n in seen.items()}
    rows = [x[:3] for x in HELD + VALIDATION]
    assert all_votes(rows, Evidence(seen)) == all_votes(rows, Evidence(more))
