import pytest

from cohortspark.operators import rollup as R
from cohortspark.operators import splits as SP


def test_collapse_first_non_null(spark):
    df = spark.createDataFrame(
        [(1, 3, 0, None, "F"), (1, 1, None, None, None), (1, 2, 1, "x", "M"), (2, 1, None, None, None)],
        "sid int, ord int, pred int, eth string, g string",
    )
    out = {r.sid: r for r in R.collapse_patients(df, ["pred"], ["eth", "g"], id_col="sid").collect()}
    assert out[1].pred == 1 and out[1].eth == "x" and out[1].g == "M"
    assert out[2].pred == 0 and out[2].eth is None


def test_cumulative_or_and_first(spark):
    df = spark.createDataFrame([(1, 1, None, None, None), (1, 1, 0, 0.2, 1), (1, 2, None, None, None)],
                               "sid int, vid int, pred int, prob double, gold int")
    out = {r.vid: r for r in R.cumulative_or(df, ["sid", "vid"], ["pred"], ["prob"], ["gold"]).collect()}
    assert (out[1].pred, out[1].prob, out[1].gold) == (0, 0.2, 1)
    assert (out[2].pred, out[2].prob, out[2].gold) == (0, 0.0, 0)
    f = R.first_per_key(spark.createDataFrame([(1, 5, "b"), (1, 2, None), (2, 9, "z")], "k int, ord int, v string"), ["k"])
    assert {r.k: r.v for r in f.collect()} == {1: None, 2: "z"}  # the first row, even with a null value


def test_patient_text(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "study_id int, ord int, text string")
    assert R.patient_text(df).collect()[0].patient_text == "a b "


def test_split_guards(spark):
    tr = spark.createDataFrame([(1, "d1"), (2, "d2")], "sid int, dg string")
    va = spark.createDataFrame([(2, "d2"), (3, "d3"), (4, "d3")], "sid int, dg string")
    assert sorted(r.sid for r in SP.exclude_leaked_docs(tr, va, "dg").collect()) == [3, 4]
    diag = SP.split_diagnostics(tr, va, "sid", "dg", ["label"], ["text", "label"])
    got = {r.check: r.n for r in diag.collect()}
    assert got == {"shared_ids": 1, "shared_digests": 1, "label_as_text": 1}
    with pytest.raises(ValueError):
        SP.assert_splits_ok(diag)
    assert SP.missing_columns(tr, ["sid", "gender"]) == ["gender"]
