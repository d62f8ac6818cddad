import numpy as np
import pytest

from cohortspark.operators import concepts as CO
from cohortspark.operators import features as FE
from cohortspark.operators import metrics as M
from cohortspark.operators.scoring import score_with
from cohortspark.operators.terms import score_terms
from cohortspark.sources import models as ST


def test_user_scorer_sees_batches_and_nulls(spark):
    def make():
        weight = np.array([0.5])  # a model would be loaded here

        def run(texts, ages):
            assert len(texts) <= 3
            return weight * np.array([len(t) for t in texts]) + np.nan_to_num(ages, nan=-1.0)

        return run

    df = spark.createDataFrame([(i, "ab" * i if i % 4 else None, i if i % 3 else None) for i in range(20)], "id int, t string, age int")
    got = {r.id: r.score for r in score_with(df, make, ["t", "age"], batch_size=3).collect()}
    assert got == {i: (i if i % 4 else 0) + (i if i % 3 else -1.0) for i in range(20)}


def test_model_store_versions(spark, tmp_path):
    path = str(tmp_path / "model")
    first = spark.createDataFrame([("a", 1.0), ("b", -2.0), (None, 0.5)], "term string, coefficient double")
    old = ST.save_model(path, {"weights": first})
    ST.save_model(path, {"weights": first.selectExpr("term", "coefficient * 2 AS coefficient")})
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    tf = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (2, "x", 4)], "doc_id int, term string, tf int")
    scores = lambda w: {r.doc_id: r.prob for r in score_terms(ids, tf, w, "doc_id").collect()}
    assert scores(ST.load_model(spark, path, old)["weights"]) == scores(first)
    assert scores(ST.load_model(spark, path)["weights"])[3] == pytest.approx(1 / (1 + np.exp(-1.0)))
    with pytest.raises(ValueError, match="no version"):
        ST.load_model(spark, path, "none")
    with pytest.raises(ValueError, match="lacks weights: scale"):
        ST.load_model(spark, path, needs={"weights": ["term", "scale"]})
    # A version without its row in the register does not count; other columns than saved are refused.
    first.write.parquet(f"{path}/unfinished/weights")
    assert ST.versions(spark, path).count() == 2
    first.select("term").write.mode("overwrite").parquet(f"{path}/{old}/weights")
    with pytest.raises(ValueError, match="other columns"):
        ST.load_model(spark, path, old)


def test_mean_vectors_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = {w: rng.normal(size=3).tolist() for w in ("gut", "pain", "ileum")}
    texts = {1: "gut gut pain unknown", 2: "", 3: None, 4: "nothing here", 5: "ileum " * 50 + "gut"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    vectors = spark.createDataFrame(list(vocab.items()), "word string, vector array<double>")
    got = {r.id: r.vector for r in FE.mean_vectors(df, "id", "t", vectors, 3).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = (t or "").split()
        want = sum((np.array(vocab.get(w, [0, 0, 0])) for w in words), np.zeros(3)) / max(1, len(words))
        assert got[i] == pytest.approx(want.tolist())
    assert FE.mean_word_vectors(df, "id", "t", vectors, 3).count() == 15


def test_average_precision_of_logits_spreads_over_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [("a", int(y), float(s)) for s, y in zip(rng.uniform(-50, 50, 3000), rng.random(3000) < 0.3)]
    rows += [("b", int(i % 2), 7.0) for i in range(50)] + [("c", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r.pr_auc for r in M.average_precision(df, ["g"], "y", "s").collect()}
    own = sorted(((s, y) for g, y, s in rows if g == "a"), reverse=True)
    hits, total, want = 0, sum(y for _, y in own), 0.0
    for i, (_, y) in enumerate(own, 1):
        hits += y
        want += y / total * hits / i
    assert got["a"] == pytest.approx(want) and got["b"] == pytest.approx(0.5) and got["c"] is None


def test_observed_concept_counts(spark):
    rows = [("1", "ENG", "PT", "gut"), ("1", "ENG", "XX", "gut"), ("2", "ENG", "SY", "arm"), ("3", "FRE", "PT", "gut"), ("4", None, "PT", "gut")]
    c = spark.createDataFrame(rows, "CUI string, LAT string, TTY string, STR string").repartition(3)
    kept, counts = CO.relevant_concepts_observed(c, ["gut"])
    assert [r.CUI for r in kept.collect()] == ["1"]
    assert counts == {"rows_in": 5, "dropped_language": 2, "dropped_kind": 1, "dropped_concept": 1}
