"""Learned cohorts (ops 95-97): document models, stacked patient models, evaluation, calibration, fairness.

The flow is the same whatever the features are (term counts, TF-IDF, mean word vectors):

1. validation documents whose text occurs in training go;
2. training patients are dealt to folds, stratified by the patient label, so that all documents of
   a patient lie in one fold;
3. per report column one model of all training documents, and one for every fold left out;
4. a patient model per report column, fitted on the scores of models that never saw the patient
   (out-of-fold scores; validation patients have the scores of the full models);
5. rows of every level: documents, visits, patients by the documents' flags (``Doc2Patient``),
   patient models (``Patient``) and their OR (``Final``), evaluated in one pass; calibration and fairness.

With several ``settings`` each column's is chosen by the mean out-of-fold ROC-AUC over the same folds.
All models of a column are fitted together (``operators.linear``), and weights stay in tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import classify as CL
from cohortspark.operators import features as FE
from cohortspark.operators import linear as LI
from cohortspark.operators import metrics as M
from cohortspark.operators import splits as SP
from cohortspark.operators import terms as TE
from cohortspark.plans import cohorts as C
from cohortspark.session import saved_table
from cohortspark.sources import sinks as SK

FITS_AT_ONCE = 8


def without_leaks(reports: DataFrame, digests: DataFrame) -> DataFrame:
    """``reports`` without the validation rows whose digest a training row has; ``digests``: doc_id, doc_digest."""
    rows = reports.join(digests, "doc_id", "left")
    train, val = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    return train.unionByName(SP.exclude_leaked_docs(train, val).select(*train.columns)).drop("doc_digest")


def patient_folds(rows: DataFrame, label: str, k: int) -> DataFrame:
    """(study_id, fold) of the training patients: stratified by patient label, a patient in one fold only."""
    patients = rows.filter("split = 'train'").groupBy("study_id").agg(F.coalesce(F.max(label), F.lit(0)).alias("_gold"))
    return FE.stratified_folds(patients, "study_id", "_gold", k).select("study_id", "fold")


def term_vectors(rows: DataFrame, texts: DataFrame, ngram_max: int = 1, max_df: float = 1.0, tfidf: bool = False, merge: str | None = None):
    """(doc_id, ids, vals), the term index and the number of features: counts or TF-IDF of the terms that training documents of the same rows have."""
    tf = saved_table(FE.bow_features(texts.join(rows.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text", ngram_max, dealt=True), "tf")
    train = rows.filter("split = 'train'").select("doc_id")
    n = train.count()
    index, size = TE.term_index(tf.join(train, "doc_id", "left_semi"), "doc_id", max_df, n, merge)
    return TE.sparse_rows(rows, tf, index, "doc_id", n if tfidf else None), index, size


def fit_and_score(
    rows: DataFrame, features: DataFrame, report_cols: Sequence[str], label: str, width: int, folds: int = 5,
    settings: Sequence[tuple[str, float]] = (("l2", 1.0),),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, prob, oof_prob), the search table (report_col, penalty, c, roc_auc) and the weights of all models.

    ``rows``: doc_id, report_col, fold (training rows; validation rows: null), label.  ``prob`` is the
    full model's; ``oof_prob`` comes from the model that left the row's fold out (validation: the full model's).
    A column without labelled training rows scores 0.
    """
    data = rows.select("doc_id", F.col("report_col").alias("grp"), "fold", F.col(label).cast("double").alias("label")).join(features, "doc_id")
    data = saved_table(data, "learn")
    weights = LI.fit_models(data, report_cols, folds, settings, width)
    scores = saved_table(LI.margins(data.drop("label"), weights, "doc_id"), "trials")
    if not folds:
        own = data.select("doc_id").join(scores, "doc_id", "left").select("doc_id", F.coalesce("prob", F.lit(0.0)).alias("prob"))
        return saved_table(own.withColumn("oof_prob", F.lit(None).cast("double")), "scores"), None, weights
    trials = data.filter("fold IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("grp").alias("report_col"), "fold", "label").join(scores, "doc_id")
    search = M.roc_auc_by(trials, ["report_col", "penalty", "c", "fold"], "label", "oof_prob").groupBy("report_col", "penalty", "c").agg(F.avg("roc_auc").alias("roc_auc"))
    search = saved_table(search, "search")
    best = {col: settings[0] for col in report_cols}
    if len(settings) > 1:
        found: dict = {}
        for r in search.orderBy(F.desc_nulls_last("roc_auc"), "penalty", "c").collect():  # columns x settings
            found.setdefault(r["report_col"], (r["penalty"], r["c"]))
        best.update(found)
    chosen = F.create_map(*[F.lit(v) for col in report_cols for v in (col, f"{best[col][0]} {float(best[col][1])}")])
    own = data.select("doc_id", chosen[F.col("grp")].alias("_own"))
    picked = own.join(scores.withColumn("_own", F.concat_ws(" ", "penalty", F.col("c").cast("string"))), ["doc_id", "_own"], "left")
    prob = F.coalesce("prob", F.lit(0.0))
    return saved_table(picked.select("doc_id", prob.alias("prob"), F.coalesce("oof_prob", prob).alias("oof_prob")), "scores"), search, weights


def stack_patients(docs: DataFrame, report_cols: Sequence[str], gold: DataFrame) -> DataFrame:
    """Patient models: (dataset, study_id, report_col, gold, pred, prob) for every patient with a report of the column.

    ``docs``: dataset, study_id, report_col, oof_prob; ``gold``: dataset, study_id, gold.  Features of a
    patient and column are the greatest and the mean out-of-fold score and the number of reports.
    """
    feats = docs.groupBy("dataset", "study_id", "report_col").agg(
        F.max("oof_prob").alias("top"), F.avg("oof_prob").alias("mean"), F.count(F.lit(1)).cast("double").alias("reports")
    )
    feats = saved_table(feats.join(gold, ["dataset", "study_id"]), "patients")

    def one(col):
        part = feats.filter(F.col("report_col") == col)
        train = part.filter("dataset = 'train'")
        kinds = train.select("gold").distinct().count()
        if kinds < 2:  # one class only: nothing to learn
            return part.select("dataset", "study_id", "report_col", "gold", F.lit(0.0).alias("prob"), F.lit(0).alias("pred"))
        out = CL.patient_meta_model(train, part, ["top", "mean", "reports"], "gold")
        return out.select("dataset", "study_id", "report_col", "gold", F.col("meta_prob").alias("prob"), F.col("meta_pred").alias("pred"))

    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        parts = list(pool.map(one, report_cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return saved_table(out, "stacked")


def learned_cohort(
    rows: DataFrame, features: DataFrame, width: int, report_cols: Sequence[str], label: str, pred_type: str, demographics: Sequence[str] = (),
    reference: DataFrame | None = None, folds: int = 5, settings: Sequence[tuple[str, float]] = (("l2", 1.0),), threshold: float = 0.5,
) -> dict:
    """The whole flow: ``documents``, ``patients`` (final rows), ``evaluation``, ``calibration``, ``fairness``, ``search``, ``weights``, ``folds``.

    ``rows``: doc_id, study_id, visit_id, report_col, ord, split, the label and demographics, without text;
    no demographics: ``fairness`` is None.
    """
    demographics = list(demographics)
    dealt = saved_table(patient_folds(rows, label, folds), "folds")
    rows = rows.join(dealt, "study_id", "left")  # validation patients have no fold
    rows = rows.withColumn("fold", F.when(F.col("split") == "train", F.col("fold")))
    scores, search, weights = fit_and_score(rows, features, report_cols, label, width, folds, settings)
    docs = rows.join(scores, "doc_id").withColumn("pred", (F.col("prob") >= threshold).cast("int"))
    docs = docs.select(
        F.col("split").alias("dataset"), "doc_id", "study_id", "visit_id", "report_col", "ord", F.col(label).alias("gold"), "pred", "prob", "oof_prob", *demographics,
    ).withColumns({"level": F.lit("document"), "pred_type": F.lit(pred_type)})
    docs = saved_table(docs, "documents")
    visit, doc2pat = C.roll_up_levels(docs, f"Cumulative_{pred_type}", demographics)
    doc2pat = saved_table(doc2pat.withColumns({"pred_type": F.lit(f"Doc2Patient_{pred_type}")}), "doc2patient")
    gold = doc2pat.select("dataset", "study_id", "gold")
    stacked = stack_patients(docs, report_cols, gold).withColumns({"level": F.lit("patient"), "pred_type": F.lit(f"Patient_{pred_type}")})
    # Final: any patient model says so; the probability is the patient's greatest document score.
    any_model = stacked.groupBy("dataset", "study_id").agg(F.max("pred").alias("pred"))
    final = doc2pat.drop("pred").join(any_model, ["dataset", "study_id"]).withColumns({"pred_type": F.lit(f"Final_{pred_type}")})
    cols = [*C.LEVEL_COLS, "gold", "pred", "prob"]
    every = docs.select(*cols)
    for part in (visit, doc2pat, stacked, final):
        every = every.unionByName(part.select(*cols))
    evaluation = saved_table(M.evaluate(every, C.LEVEL_COLS, "gold", "pred", "prob"), "evaluation")
    return {
        "documents": docs, "patients": final, "stacked": stacked, "evaluation": evaluation, "calibration": SK.calibration_summary(evaluation),
        "fairness": C.cohort_fairness(final, demographics, reference) if demographics else None, "search": search, "weights": weights, "folds": dealt,
    }


def text_cohort(
    reports: DataFrame, texts: DataFrame, digests: DataFrame, report_cols: Sequence[str], label: str, pred_type: str = "BOW",
    ngram_max: int = 1, max_df: float = 1.0, tfidf: bool = False, **learn,
) -> dict:
    """Bag-of-words and TF-IDF families (ops 95, 96): ``reports`` without text, ``texts`` (doc_id, text)."""
    rows = saved_table(without_leaks(reports, digests), "rows")
    kinds = {penalty for penalty, _ in learn.get("settings", (("l2", 1.0),))}
    merge = kinds.pop() if len(kinds) == 1 else None  # one penalty: terms of one document share a feature
    features, index, width = term_vectors(rows, texts, ngram_max, max_df, tfidf, merge)
    return learned_cohort(rows, features, width, report_cols, label, pred_type, **learn) | {"index": index}


def embedding_cohort(
    reports: DataFrame, texts: DataFrame, digests: DataFrame, word_vectors: DataFrame, report_cols: Sequence[str], label: str,
    dim: int = 64, pred_type: str = "Embedding", settings: Sequence[tuple[str, float]] = (("l1", 1.0),), **learn,
) -> dict:
    """Embedding family (op 97): mean word vectors of a document; documents without a known word are the zero vector."""
    rows = saved_table(without_leaks(reports, digests), "rows")
    means = FE.mean_vectors(texts.join(rows.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text", word_vectors, dim)
    values = F.coalesce("vector", F.array().cast("array<double>"))
    numbers = F.transform(values, lambda v, i: i.cast("bigint"))
    features = rows.select("doc_id").join(means, "doc_id", "left").select("doc_id", numbers.alias("ids"), values.alias("vals"))
    return learned_cohort(rows, saved_table(features, "features"), dim + 1, report_cols, label, pred_type, settings=settings, **learn)


def text_model(
    reports: DataFrame, texts: DataFrame, label: str, ngram_max: int = 1, max_df: float = 1.0, tfidf: bool = False,
    penalty: str = "l2", c: float = 1.0, threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """One text classifier over all reports (ops 71, 76): (doc_id, split, prob, pred) and (term, coefficient), fitted on training rows."""
    rows = reports.select("doc_id", "split", F.lit("all").alias("report_col"), F.when(F.col("split") == "train", F.lit(0)).alias("fold"), label)
    rows = saved_table(rows, "rows")
    labelled = rows.filter((F.col("split") == "train") & F.col(label).isNotNull()).select("doc_id")
    tf = saved_table(FE.bow_features(texts, "doc_id", "text", ngram_max), "tf")
    n = labelled.count()
    index, size = TE.term_index(tf.join(labelled, "doc_id", "left_semi"), "doc_id", max_df, n, penalty)
    features = TE.sparse_rows(rows, tf, index, "doc_id", n if tfidf else None)
    scores, _, weights = fit_and_score(rows, features, ["all"], label, size, 0, [(penalty, c)])
    out = rows.select("doc_id", "split").join(scores.select("doc_id", "prob"), "doc_id")
    return out.withColumn("pred", (F.col("prob") >= threshold).cast("int")), TE.term_weights(weights, index).select("term", "coefficient")


def table_cohort(
    reports: DataFrame, tf: DataFrame, coefficients: DataFrame, label: str, pred_type: str = "Table", threshold: float = 0.5,
    demographics: Sequence[str] = (),
) -> dict:
    """A cohort scored by a table of coefficients (term, coefficient), fitted here or elsewhere: levels and evaluation."""
    scored = TE.score_terms(reports, tf, coefficients, "doc_id", "prob")
    scored = scored.withColumn("pred", (F.col("prob") >= threshold).cast("int"))
    docs = C._doc_level(scored, label, pred_type, list(demographics))
    visit, patients = C.roll_up_levels(docs, pred_type, list(demographics))
    return {"docs": docs, "visits": visit, "patients": patients, "evaluation": C.evaluate_levels(docs, visit, patients)}
