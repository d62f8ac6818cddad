"""Term index, many models at once, out-of-fold stacking and the learned cohorts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import classify as CL
from cohortspark.operators import features as FE
from cohortspark.operators import linear as LI
from cohortspark.operators import metrics as M
from cohortspark.operators import terms as TE
from cohortspark.operators.ranks import with_positions
from cohortspark.plans import learned as L
from cohortspark.sources import testdata_view as TV


def test_positions_in_groups(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(200)]
    got = with_positions(spark.createDataFrame(rows, "g int, o int, i int").repartition(5), ["g"], ["o", "i"], "pos", "n").collect()
    by = {}
    for g, o, i in sorted(rows, key=lambda r: r[1:]):
        by.setdefault(g, []).append((o, i))
    assert {(r["g"], r["o"], r["i"], r["pos"], r["n"]) for r in got} == {(g, o, i, k, len(v)) for g, v in by.items() for k, (o, i) in enumerate(v)}
    assert with_positions(spark.createDataFrame([], "g int, o int"), ["g"], ["o"]).count() == 0


def test_three_million_terms(spark):
    tf = spark.range(3_000_000).select((F.col("id") % 1000).alias("doc"), F.format_string("t%07d", "id").alias("term"), F.lit(1).alias("tf"))
    index, size = TE.term_index(tf, "doc")
    wrong = F.count_if(F.col("feature") != F.substring("term", 2, 7).cast("long"))
    assert size == 3_000_000 and index.agg(wrong, F.countDistinct("feature")).first()[:] == (0, size)


def _corpus(spark, n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        words = rng.choice(["colon", "biopsy", "normal", "report", "seen", "left"], rng.integers(1, 9)).tolist()
        words += ["inflamed" if y ^ (rng.random() < 0.2) else "healthy"]
        words += [f"only{i}"] * int(rng.integers(0, 3)) + [f"rare{i}"] * int(rng.integers(0, 2))
        rows.append((i, " ".join(words) if i % 30 else None, y if i % 11 else None, i % 3, "ab"[i % 2]))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, fold int, grp string")


def _features(df, merge=None, tfidf=False):
    tf = FE.bow_features(df, "doc_id", "text")
    n = df.count()
    index, size = TE.term_index(tf, "doc_id", merge=merge)
    return TE.sparse_rows(df, tf, index, "doc_id", n if tfidf else None), index, size, tf


@pytest.mark.parametrize("penalty, tfidf", [("l2", False), ("l2", True), ("l1", False)])
def test_terms_of_one_document_share_a_feature(spark, penalty, tfidf):
    df = _corpus(spark)
    probs = []
    for merge in (None, penalty):
        feats, index, size, _ = _features(df, merge, tfidf)
        weights = LI.fit_models(df.join(feats, "doc_id"), ["a", "b"], 3, [(penalty, 1.0)], size, tol=1e-9)
        got = LI.margins(df.join(feats, "doc_id"), weights, "doc_id").collect()
        probs.append({r["doc_id"]: (r["prob"], r["oof_prob"]) for r in got})
    assert size < _features(df)[2] and probs[0].keys() == probs[1].keys() and len(probs[0]) == 90
    assert all(np.allclose(probs[0][i], probs[1][i], atol=2e-3) for i in probs[0])


def test_both_ways_of_fitting_agree(spark):
    df = _corpus(spark, 500)
    feats, index, size, tf = _features(df)
    data = df.join(feats, "doc_id")
    settings = [("l2", 0.1), ("l2", 1.0), ("l1", 1.0)]
    tasks, spread = (LI.fit_models(data, ["a", "b"], 1, settings, size, task_rows=n, tol=1e-9) for n in (20_000, 0))
    full = lambda w: {tuple(r)[:3]: (r["prob"], r["oof_prob"]) for r in LI.margins(data, w, "doc_id").collect()}
    one, two = full(tasks), full(spread)
    assert one.keys() == two.keys() and len(one) == 1500
    assert max(abs(one[k][0] - two[k][0]) for k in one) < 1e-3
    # the weights of one model against the plain solver
    rows = [r for r in data.filter("grp = 'a' AND label IS NOT NULL").collect()]
    x = (np.concatenate([r["ids"] for r in rows]).astype(int), np.concatenate([r["vals"] for r in rows]), np.repeat(range(len(rows)), [len(r["ids"]) for r in rows]))
    w = CL._fit_logistic(x, np.array([r["label"] for r in rows], float), size, 1.0, False, 20_000, 1e-10)
    mine = np.zeros(size + 1)
    for r in tasks.filter("grp = 'a' AND held = -1 AND penalty = 'l2' AND c = 1.0").collect():
        mine[r["feature"]] = r["weight"]
    assert np.abs(mine - w).max() < 1e-4
    # scores by a join on the term are those by feature number
    coefs = TE.term_weights(tasks.filter("grp = 'a' AND held = -1 AND penalty = 'l2' AND c = 1.0"), index).select("term", "coefficient")
    by_term = {r["doc_id"]: r["prob"] for r in TE.score_terms(df.filter("grp = 'a'").select("doc_id"), tf, coefs, "doc_id").collect()}
    assert all(abs(by_term[k[0]] - v[0]) < 1e-9 for k, v in one.items() if k[1:] == ("l2", 1.0) and k[0] in by_term) and len(by_term) == 250


def test_roc_auc_by_key(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(rng.random() < 0.3), float(rng.integers(0, 9)) / 8) for k in rng.integers(0, 4, 300)] + [(9, 1, 0.5)]
    got = {r["k"]: r["roc_auc"] for r in M.roc_auc_by(spark.createDataFrame(rows, "k int, y int, s double"), ["k"], "y", "s").collect()}
    for k in range(4):
        own = [r for r in rows if r[0] == k]
        assert abs(got[k] - CL.roc_auc(np.array([r[2] for r in own]), np.array([float(r[1]) for r in own]))) < 1e-12
    assert got[9] is None


@pytest.fixture(scope="module")
def archive(spark):
    rng = np.random.default_rng(8)
    rows, texts = [], []
    for i in range(360):
        study, y = i // 6, int(rng.random() < 0.35)
        words = rng.choice(["colon", "biopsy", "normal", "report"], 5).tolist() + ["inflamed" if y else "healthy"]
        split = "validation" if study % 5 == 0 else "train"
        rows.append((i, study, i // 2 % 3, ["one", "two"][i % 2], i, y if i % 13 else None, split, ["f", "m", None][study % 3]))
        texts.append((i, " ".join(words) + (f" w{i}" if i % 4 else "")))
    texts[0] = (0, texts[10][1])  # a validation document that training has as well
    cols = "doc_id long, study_id long, visit_id int, report_col string, ord long, gold int, split string, gender string"
    return spark.createDataFrame(rows, cols), spark.createDataFrame(texts, "doc_id long, text string")


def test_learned_cohort(spark, archive):
    reports, texts = archive
    digests = texts.select("doc_id", F.md5("text").alias("doc_digest"))
    run = L.text_cohort(reports, texts, digests, ["one", "two"], "gold", "BOW", folds=3, demographics=["gender"], settings=[("l2", 0.1), ("l2", 1.0)])
    kept = L.without_leaks(reports, digests).select("doc_id")
    assert kept.filter("doc_id = 0").count() == 0
    docs = run["documents"].collect()
    assert len(docs) == kept.count()
    # folds: training patients only, each in one fold, classes spread evenly
    folds = {}
    for r in run["folds"].collect():
        assert r["study_id"] not in folds
        folds[r["study_id"]] = r["fold"]
    gold = {}
    for r in docs:
        if r["dataset"] == "train":
            gold[r["study_id"]] = max(gold.get(r["study_id"], 0), r["gold"] or 0)
    assert folds.keys() == gold.keys()
    for y in (0, 1):
        sizes = [sum(folds[s] == k and gold[s] == y for s in folds) for k in range(3)]
        assert max(sizes) - min(sizes) <= 1
    # an out-of-fold score is that of a model fitted on the other folds' patients alone
    best = {r["report_col"]: (r["penalty"], r["c"]) for r in run["search"].orderBy("roc_auc").collect()}
    rows = L.without_leaks(reports, digests).filter("split = 'train' AND report_col = 'one'").join(run["folds"], "study_id")
    other = rows.select("doc_id", F.col("report_col").alias("grp"), F.when(F.col("fold") != 1, F.lit(0)).alias("fold"), F.col("gold").alias("label"))
    feats, index, size = L.term_vectors(L.without_leaks(reports, digests), texts)
    data = other.join(feats, "doc_id")
    own = LI.margins(data, LI.fit_models(data, ["one"], 0, [best["one"]], size), "doc_id")
    alone = {r["doc_id"]: r["prob"] for r in own.collect()}
    held = [r for r in docs if r["report_col"] == "one" and folds.get(r["study_id"]) == 1]
    assert held and all(abs(alone[r["doc_id"]] - r["oof_prob"]) < 2e-3 for r in held)
    assert any(abs(r["prob"] - r["oof_prob"]) > 0.01 for r in held)
    # every level has its rows, in both splits
    kinds = {(r["dataset"], r["pred_type"]) for r in run["evaluation"].collect()}
    assert kinds == {(d, p + "BOW") for d in ("train", "validation") for p in ("", "Cumulative_", "Doc2Patient_", "Patient_", "Final_")}
    final = {(r["dataset"], r["study_id"]): r for r in run["patients"].collect()}
    stacked = {}
    for r in run["stacked"].collect():
        stacked.setdefault((r["dataset"], r["study_id"]), []).append(r["pred"])
    assert {k: r["pred"] for k, r in final.items()} == {k: max(v) for k, v in stacked.items()}
    assert run["fairness"].filter("attribute = 'gender' AND level = 'group'").count() == 4
    assert run["calibration"].count() == 7
    valid = [r for r in docs if r["dataset"] == "validation" and r["gold"] is not None]
    assert np.mean([r["pred"] == r["gold"] for r in valid]) > 0.9


def test_column_without_labels_scores_zero(spark, archive):
    reports, texts = archive
    bare = reports.withColumn("gold", F.when(F.col("report_col") == "one", F.col("gold")))
    run = L.text_cohort(bare, texts, texts.select("doc_id", F.lit(None).cast("string").alias("doc_digest")), ["one", "two"], "gold", folds=2)
    assert {r["prob"] for r in run["documents"].filter("report_col = 'two'").collect()} == {0.0}


def test_embedding_cohort(spark, archive):
    reports, texts = archive
    words = ["colon", "biopsy", "normal", "report", "inflamed", "healthy"]
    vectors = spark.createDataFrame([(w, [float(i == k) for k in range(6)]) for i, w in enumerate(words)], "word string, vector array<float>")
    digests = texts.select("doc_id", F.col("doc_id").cast("string").alias("doc_digest"))
    run = L.embedding_cohort(reports, texts, digests, vectors, ["one", "two"], "gold", dim=6, folds=2, settings=[("l1", 10.0)])
    ev = run["evaluation"].filter("dataset = 'validation' AND level = 'document'").collect()
    assert len(ev) == 2 and all(r["accuracy"] > 0.9 for r in ev)


def test_text_model(spark, archive):
    reports, texts = archive
    scores, coefs = L.text_model(reports, texts, "gold")
    assert scores.count() == 360
    weight = {r["term"]: r["coefficient"] for r in coefs.collect()}
    assert weight["inflamed"] > 0 > weight["healthy"] and None in weight
    assert TV.REPORT_SLOTS  # the fixture's slots stay the queries' report columns
