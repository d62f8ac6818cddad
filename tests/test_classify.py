"""Text classifiers: solver against Spark ML, search against a by-hand count, TF-IDF weighting."""

import math

import numpy as np
from pyspark.sql import functions as F

from cohortspark.operators import classify as CL
from cohortspark.operators import features as FE


def _texts(n=60):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = i % 2
        words = rng.choice(["colon", "biopsy", "normal", "report", "seen"], 6).tolist()
        if rng.random() < 0.8:
            words.append("inflamed" if y else "healthy")
        rows.append((i, " ".join(words) if i != 7 else None, y, (i // 2) % 5))
    return rows


def test_roc_auc_counts_pairs():
    score, y = np.array([0.1, 0.4, 0.4, 0.8, 0.3]), np.array([0.0, 1.0, 0.0, 1.0, 0.0])
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    assert CL.roc_auc(score, y) == np.mean(pairs)
    assert math.isnan(CL.roc_auc(score, np.ones(5)))


def test_solver_agrees_with_spark(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (80, 5)).astype(float)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, 80) > 0).astype(float)
    rows, cols = np.nonzero(x)
    df = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)], ["features", "label"])
    for penalty in ("l1", "l2"):
        w = CL._fit_logistic((cols, x[rows, cols], rows), y, 5, 1.0, penalty == "l1", 5000, 1e-9)
        m = CL._lr(1.0, 80, penalty).setTol(1e-10).fit(df)
        assert np.allclose(w, np.append(m.coefficients.toArray(), m.intercept), atol=2e-3), penalty


def test_grid_search_and_refit(spark):
    df = spark.createDataFrame(_texts(), "id int, text string, y int, fold int")
    grid = CL.grid_search(df, "text", "y", "fold")
    got = {(r.max_df, r.ngram_max, r.penalty, r.c): r.roc_auc for r in grid.collect()}
    assert len(got) == 2 * 2 * 2 * 4 and all(0.0 <= v <= 1.0 for v in got.values())
    assert max(got.values()) > 0.8
    model, grid = CL.search_text_classifier(df, "text", "y", tfidf=True)
    best = CL.best_setting(grid)
    assert grid.filter(f"roc_auc > {max(r.roc_auc for r in grid.collect())}").count() == 0 and set(best) == {"max_df", "ngram_max", "penalty", "c"}
    out = CL.predict_text(model, df).collect()
    assert len(out) == 60 and sum(r.pred == r.y for r in out) > 45
    grid.unpersist()


def test_grid_search_of_nothing(spark):
    df = spark.createDataFrame([], "id int, text string, y int, fold int")
    assert CL.grid_search(df, "text", "y", "fold").collect() == []
    assert CL.search_text_classifier(df, "text", "y")[0] is None


def test_tfidf_stages_equal_the_long_form(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame(_texts(20), "id int, text string, y int, fold int")
    model = CL.fit_features(CL.text_pipeline("text", 1, 1.0, True), df)
    sums = {r.id: r.s for r in model.transform(df).selectExpr("id", "features").withColumn("a", vector_to_array("features")).selectExpr(
        "id", "aggregate(a, 0D, (x, y) -> x + y) AS s").collect()}
    docs = df.agg({"id": "count"}).toDF("n")  # an empty text counts as a document
    want = FE.tfidf_features(FE.bow_features(df, "id", "text"), "id", docs).groupBy("id").sum("weight").collect()
    for r in want:
        assert abs(sums[r.id] - r["sum(weight)"]) < 1e-9


def test_models_score_after_the_session_has_observed_metrics(spark):
    """A model's training summary holds the session, which cannot be sent to tasks after an observation."""
    from pyspark.sql import Observation

    spark.range(3).observe(Observation("rows"), F.count(F.lit(1)).alias("n")).collect()
    rows = spark.createDataFrame([(i, float(i % 7), [float(i % 7), 1.0], "good word" if i % 2 else "bad thing", i % 2) for i in range(40)], "id int, x double, v array<double>, t string, y int")
    assert CL.patient_meta_model(rows, rows, ["x"], "y").count() == 40
    assert CL.predict_embedding(CL.embedding_classifier(rows, "v", "y"), rows, "v").count() == 40
    found = CL.predict_text(CL.train_text_classifier(rows, "t", "y"), rows).select("y", "pred").collect()
    assert all(r["y"] == r["pred"] for r in found)
