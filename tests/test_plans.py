"""Physical-plan guards: no cross / nested-loop joins, no row-at-a-time Python, pruned scans."""

from conftest import SF_SMALL

from cohortspark.plans import registry

FITS = {"grid_search", "bow_cohort", "bow_cohort_fairness", "bow_cohort_search", "tfidf_cohort", "tfidf_cohort_calibration",
        "embedding_cohort", "train_text_classifier", "predict_text",
        "embedding_classifier", "patient_meta_model", "odds_ratios", "label_tree", "doc_to_patient_study", "vif"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_or_nested_loop_joins(spark):
    for name, fn in registry.queries().items():
        if name in FITS:
            continue
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name  # only Arrow-batched pandas UDFs are allowed


def test_text_side_scan_is_pruned(spark):
    import __spark_entry__ as E

    import re

    plan = _plan(E.queries()["regex_cohort"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    text_scans = [s for s in schemas if "text:string" in s]
    # the text is read once, narrow, on the text side; the label side never reads it
    assert set(text_scans) == {"struct<doc_id:bigint,text:string>"}
    assert len(schemas) >= 2
