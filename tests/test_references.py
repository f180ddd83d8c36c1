import datetime as dt

from terrane.operators import references as R

T = lambda d: dt.datetime(2025, 1, d)


def frames(spark):
    recs = [(1, 10, T(5)), (2, 11, T(5)), (3, 12, T(5)), (4, None, T(5)), (5, 0, T(5)), (6, 13, T(2)), (7, 13, T(9)), (8, 13, None), (1, 10, T(5)), (9, 14, T(1)), (None, 11, T(1))]
    r = spark.createDataFrame([(*x, "s", "k") for x in recs], "id long, ref long, at timestamp_ntz, src_table string, key string")
    reg = spark.createDataFrame([(10, T(1)), (10, T(8)), (13, T(4)), (13, T(6)), (14, None), (None, T(1)), (15, T(1))], "document_id long, create_time timestamp_ntz")
    log = spark.createDataFrame([(12,), (12,), (10,), (None,), (77,)], "document_id long")
    return R.references(r, "t", "id", "ref", "at"), reg, log


def test_reasons_nulls_and_repeats(spark):
    refs, reg, log = frames(spark)
    got = {(x.row_id, x.reason) for x in R.reference_report([refs], reg, log).collect()}
    assert got == {(1, "deleted"), (2, "missing"), (3, "deleted"), (6, "late"), (None, "missing")}
    assert R.reference_report([refs], reg, log).count() == 5


def test_deltas_in_any_batches_give_the_same_state(spark):
    refs, reg, log = frames(spark)
    whole = R.apply_deltas(None, [R.reference_deltas(refs), R.registration_deltas(reg), R.removal_deltas(log)])
    step = R.apply_deltas(None, [R.removal_deltas(log)])
    step = R.apply_deltas(step, [R.reference_deltas(refs), R.reference_deltas(refs)])
    step = R.apply_deltas(step, [R.registration_deltas(reg), R.reference_deltas(refs, -1)])
    assert sorted(whole.collect(), key=str) == sorted(step.collect(), key=str)
    assert {(x.key, x.refs, x.reason) for x in R.orphan_keys(whole).collect()} == {(10, 2, "deleted"), (11, 2, "missing"), (12, 1, "deleted")}
    gone = R.apply_deltas(whole, [R.reference_deltas(refs, -1)])
    assert R.orphan_keys(gone).count() == 0


def test_hot_key_is_salted_and_whole(spark):
    n = 60_000
    refs = spark.range(n).selectExpr("'t' AS src_table", "id AS row_id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id + 100 END AS key", "timestamp_ntz'2025-01-01' AS at")
    reg = spark.range(100, n + 100).selectExpr("id AS document_id", "timestamp_ntz'2024-01-01' AS create_time")
    log = spark.createDataFrame([], "document_id long")
    got = R.reference_report([refs], reg, log)
    assert got.count() == n // 3 and got.where("reason <> 'missing'").count() == 0


def test_empty_tables(spark):
    refs, reg, log = frames(spark)
    assert R.reference_report([refs.limit(0)], reg.limit(0), log.limit(0)).count() == 0
    assert R.by_period(R.reference_report([refs], reg.limit(0), log.limit(0))).count() == 2
