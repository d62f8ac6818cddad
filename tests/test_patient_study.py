import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from cohortspark.operators import metrics as M
from cohortspark.operators import study as ST
from cohortspark.plans import registry


def test_tree_report_is_that_of_its_own_predictions(spark):
    # the label is "a but not b": the tree finds it, an OR of the flags does not
    rows = [(a, b, int(a and not b)) for a in (0, 1) for b in (0, 1) for _ in range(5)]
    df = spark.createDataFrame(rows, "a int, b int, patient int")
    table, counts = ST.fit_label_tree(df, ["a", "b"], "patient")
    assert counts.first().asDict() == {"n": 20, "tp": 5, "fp": 0, "fn": 0, "tn": 15}
    report = {r["class"]: r["f1"] for r in M.per_class_report(counts.withColumn("k", F.lit("all")), ["k"]).collect()}
    assert report["0"] == report["1"] == report["accuracy"] == 1.0
    assert {r["kind"]: r["value"] for r in table.collect()}["accuracy"] == 1.0


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "a int, b int, patient int")
    table, counts = ST.fit_label_tree(one, ["a", "b"], "patient")
    assert counts.first().asDict() == {"n": 2, "tp": 0, "fp": 0, "fn": 0, "tn": 2} and table.count() == 3
    table, counts = ST.fit_label_tree(one.filter("a > 5"), ["a", "b"], "patient")
    assert table.count() == counts.count() == ST.odds_ratios(one.filter("a > 5"), ["a", "b"], "patient").count() == 0


def test_study_of_labels_and_flags(spark):
    out = registry.QUERIES["doc_to_patient_study"](spark, SF_SMALL).collect()
    parts = ["correlation", "vif", "odds_l1", "odds_l2", "tree_importance", "tree_accuracy", "per_class_f1"]
    assert {r["section"] for r in out} == {*parts, *(f"labels_{p}" for p in parts), "or_per_class_f1"}
    # the tree's accuracy is that of its report, and labels are not flags
    value = {(r["section"], r["name"]): r["value"] for r in out}
    for kind in ("", "labels_"):
        assert value[f"{kind}per_class_f1", "accuracy"] == value[f"{kind}tree_accuracy", ""]
    docs = registry.reports(spark, SF_SMALL, False).select("study_id", "visit_id", "report_col", "gold_alt").collect()
    visits, gold = {}, {}
    for r in (r for r in docs if r["gold_alt"] is not None):
        visits.setdefault((r["study_id"], r["visit_id"]), {})[r["report_col"]] = r["gold_alt"]
        gold[r["study_id"]] = max(gold.get(r["study_id"], 0), r["gold_alt"])
    whole = [(v["pathology"], gold[k[0]]) for k, v in visits.items() if len(v) == 4]
    x, y = np.array(whole, float).T
    got = value["labels_correlation", "pathology~patient"]
    assert got is None if not x.std() * y.std() else abs(got - np.corrcoef(x, y)[0, 1]) < 1e-6
