"""Text and embedding classifiers on Spark ML (ops 71, 74, 76, 79, 81).

Final fits are distributed (``LogisticRegression`` is a treeAggregate over partitions); the
grid search fits all strengths of a fold on one matrix (``operators.linear``; the stratified folds of
``features.stratified_folds``).
The reference's solver penalises summed losses with strength 1/C; Spark
averages, so the penalty maps to ``regParam = 1 / (C * n)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import text as tx


def log_count_ratio(tf: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(feature, coefficient): smoothed log ratio of a term's document share in the
    positive vs negative class, a closed-form linear weight for explanation tables."""
    lab = labels.select(id_col, F.col("y").cast("long").alias("y"))
    npos = lab.agg(F.sum("y").alias("v")).select("v").scalar()
    nneg = lab.agg((F.count(F.lit(1)) - F.sum("y")).alias("v")).select("v").scalar()
    tl = tf.join(lab, on=id_col, how="inner").groupBy("term").agg(
        F.sum("y").alias("p"), (F.count(F.lit(1)) - F.sum("y")).alias("q")
    )
    coef = F.log((F.col("p") + 1.0) / (npos + 2.0)) - F.log((F.col("q") + 1.0) / (nneg + 2.0))
    return tl.select(F.col("term").alias("feature"), coef.alias("coefficient"))


def _lr(c: float, n: float, penalty: str, weight_col: str | None = None):
    from pyspark.ml.classification import LogisticRegression

    kw = dict(
        featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n, 1.0)),
        elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False, maxIter=1000,
    )
    if weight_col:
        kw["weightCol"] = weight_col
    return LogisticRegression(**kw)


def _reloaded(model):
    """``model`` through the shared checkpoint folder.  A fitted model carries its training summary and with it
    the session, which cannot be sent to tasks once the session has observed metrics; a loaded one has none."""
    from cohortspark.session import new_folder

    path = new_folder(SparkSession.active(), "fitted")
    model.write().save(path)
    return type(model).load(path)


def text_pipeline(text_col: str, ngram_max: int = 1, max_df: float = 1.0, tfidf: bool = False, vocab_size: int = 2**31 - 1):
    """Feature stages: tokens of >= 2 word characters (lower-cased), uni(+bi)-grams, counts (+IDF, L2)."""
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer

    stages = [
        SQLTransformer(statement=f"SELECT *, coalesce({text_col}, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=tx.TOKEN_2PLUS, gaps=False, toLowercase=True, minTokenLength=1),
    ]
    terms = "_tok"
    if ngram_max >= 2:
        stages += [
            NGram(n=2, inputCol="_tok", outputCol="_bi"),
            SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
        ]
        terms = "_terms"
    # Spark reads a maxDF of 1 and more as a number of documents: a share of 1 is no limit.
    share = {"maxDF": max_df} if max_df < 1.0 else {}
    stages.append(CountVectorizer(inputCol=terms, outputCol="_tf" if tfidf else "features", vocabSize=vocab_size, **share))
    if tfidf:
        stages.append(IDF(inputCol="_tf", outputCol="_idf"))
    return stages


def fit_features(stages: list, d: DataFrame):
    """The fitted feature stages.  Spark's idf is ln((n+1)/(df+1)); the weighting wants one more, so
    counts are scaled by idf + 1 and normalised."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import ElementwiseProduct, IDFModel, Normalizer
    from pyspark.ml.linalg import Vectors

    fitted = Pipeline(stages=stages).fit(d).stages
    if isinstance(fitted[-1], IDFModel):
        weights = Vectors.dense(fitted[-1].idf.toArray() + 1.0)
        fitted = [*fitted[:-1], ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol="_idf"),
                  Normalizer(inputCol="_idf", outputCol="features", p=2.0)]
    return PipelineModel(stages=list(fitted))


# op 71
def train_text_classifier(
    train: DataFrame, text_col: str, label_col: str, ngram_max: int = 1, max_df: float = 1.0, tfidf: bool = False,
    c: float = 1.0, penalty: str = "l2",
):
    """Vectoriser + logistic regression on rows with text and label; None when no rows remain."""
    from pyspark.ml import PipelineModel

    d = train.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).withColumn("label", F.col(label_col).cast("double"))
    n = d.count()
    if n == 0:
        return None
    features = fit_features(text_pipeline(text_col, ngram_max, max_df, tfidf), d)
    return PipelineModel(stages=[features, _reloaded(_lr(c, n, penalty).fit(features.transform(d)))])


# op 76
def predict_text(model, df: DataFrame, out_prob: str = "prob", out_pred: str = "pred", threshold: float = 0.5) -> DataFrame:
    """P(1) and label from a fitted pipeline; no model -> zeros.  Null text is scored as ''."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return df.withColumns({out_prob: F.lit(0.0), out_pred: F.lit(0)})
    cols = df.columns
    p = model.transform(df).withColumn(out_prob, vector_to_array("probability")[1])
    return p.select(*cols, out_prob).withColumn(out_pred, (F.col(out_prob) >= threshold).cast("int"))


# op 74
def _fit_logistic(x, y, width, c, l1, max_iter, tol, start=None):
    """Weights and free intercept (last) minimising C * summed loss + penalty: accelerated proximal
    steps with restarts, until the largest change of a step is below ``tol`` of the largest weight."""
    cols, vals, rows = x
    n = len(y)
    dot = lambda w: np.bincount(rows, vals * w[cols], n) + w[width]
    back = lambda r: np.append(np.bincount(cols, vals * r[rows], width), r.sum())
    v = np.random.default_rng(0).standard_normal(width + 1)
    for _ in range(30):  # largest eigenvalue of the loss's curvature bound
        v /= np.linalg.norm(v)
        v = back(dot(v))
    step = 1.0 / (c * 0.25 * 1.05 * np.linalg.norm(v) + (0.0 if l1 else 1.0))
    w = np.zeros(width + 1) if start is None else start.copy()
    z, t = w, 1.0
    for _ in range(max_iter):
        g = c * back(1.0 / (1.0 + np.exp(-np.clip(dot(z), -500, 500))) - y)
        if not l1:
            g[:width] += z[:width]
        new = z - step * g
        if l1:
            new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - step, 0.0)
        if ((z - new) * (new - w)).sum() > 0:  # momentum points uphill: start anew
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, change = new + (t - 1) / after * (new - w), np.abs(new - w).max()
        w, t = new, after
        if change <= tol * max(1.0, np.abs(w).max()):
            break
    return w


def roc_auc(score, y) -> float:
    """Chance that a positive scores above a negative, ties half; nan with one class only."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return float("nan")
    _, place, many = np.unique(score, return_inverse=True, return_counts=True)
    rank = np.cumsum(many) - (many - 1) / 2.0
    return float((rank[place][y == 1].sum() - n1 * (n1 + 1) / 2.0) / (n1 * n0))


def _fold_rows(rows: DataFrame, n_gram: int, max_dfs, num_folds: int, tfidf: bool) -> tuple[DataFrame, int]:
    """(sparse rows of every (document share, held-out fold): grp, _id, ids, vals; features as the other folds' rows give them; their number)."""
    from cohortspark.operators.features import bow_features
    from cohortspark.operators.ranks import with_positions
    from cohortspark.session import saved_table

    tf = saved_table(bow_features(rows, "_id", "_text", n_gram, also=["_fold"]), "grid-tf")
    n = {r["_fold"]: r["count"] for r in rows.groupBy("_fold").count().collect()}  # a number per fold
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *[F.count_if(F.col("_fold") == k).alias(f"d{k}") for k in range(num_folds)])
    index = saved_table(with_positions(df, [], ["term"], "feature"), "grid-terms")
    width = index.count()
    seen = {k: sum(n.values()) - n.get(k, 0) for k in range(num_folds)}
    groups = F.array(*[
        F.struct(F.lit(f"{share} {k}").alias("grp"), (F.col("df") - F.col(f"d{k}")).alias("df"), F.lit(seen[k]).alias("n"), F.lit(share * seen[k]).alias("most"))
        for share in max_dfs for k in range(num_folds)
    ])
    index = index.select("term", "feature", F.explode(groups).alias("g")).select("term", "feature", "g.*").filter("df > 0 AND df <= most")
    value = F.col("tf").cast("double")
    if tfidf:
        value = value * (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0)
    met = tf.join(index, "term").select("_id", "grp", F.struct(F.col("feature").alias("f"), value.alias("v")).alias("_e"))
    out = met.groupBy("_id", "grp").agg(F.array_sort(F.collect_list("_e")).alias("_e"), F.sqrt(F.sum(F.col("_e.v") ** 2)).alias("_norm"))
    vals = F.transform("_e", lambda e: e["v"] / F.col("_norm") if tfidf else e["v"])
    return out.select("_id", "grp", F.transform("_e", lambda e: e["f"]).alias("ids"), vals.alias("vals")), width


def grid_search(
    train: DataFrame, text_col: str, label_col: str, fold_col: str = "fold", max_dfs=(0.75, 1.0), ngrams=(1, 2),
    penalties=("l1", "l2"), cs=(0.01, 0.1, 1.0, 10.0), tfidf: bool = False, num_folds: int = 5, tol: float = 1e-5,
) -> DataFrame:
    """k-fold search by ROC-AUC: (max_df, ngram_max, penalty, c, roc_auc), the mean over the folds.

    All labelled rows take part.  Vocabulary, document share and IDF come from each fold's training rows: the
    index of terms holds a term's documents per fold, and a row has features for every (share, held-out fold).
    These are the groups of ``linear.fit_models``, which fits all penalties and strengths of a group
    on one matrix; held-out rows are scored by joins with the table of weights.
    Folds whose held-out rows have one class only do not count; a null text is empty; a table
    without labelled rows gives no rows.
    """
    from cohortspark.operators import linear as LI
    from cohortspark.operators.metrics import roc_auc_by
    from cohortspark.session import saved_table

    rows = train.filter(F.col(label_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
        F.col(label_col).cast("double").alias("label"), F.col(fold_col).cast("int").alias("_fold"),
    )
    rows = saved_table(rows, "grid-rows")  # fixes the numbers
    settings = [(p, c) for p in penalties for c in cs]
    groups = [f"{share} {k}" for share in max_dfs for k in range(num_folds)]
    every = rows.select("_id", "label", "_fold", F.explode(F.array(*[F.lit(g) for g in groups])).alias("grp"))
    held = F.split("grp", " ")[1].cast("int")
    out = None
    for n_gram in ngrams:
        features, width = _fold_rows(rows, n_gram, max_dfs, num_folds, tfidf)
        found = every.join(features, ["_id", "grp"], "left")
        none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
        data = found.select("_id", "grp", "label", F.when(F.col("_fold") != held, F.lit(0)).alias("fold"), none("ids", "bigint"), none("vals", "double"))
        data = saved_table(data, "grid-data")
        weights = LI.fit_models(data, groups, 0, settings, width, tol=tol)
        tested = data.filter("fold IS NULL").withColumn("_id", F.struct("_id", "grp", "label"))
        scores = LI.margins(tested, weights, "_id").select("_id.grp", "_id.label", "penalty", "c", "prob")
        aucs = roc_auc_by(scores, ["grp", "penalty", "c"], "label", "prob")
        part = aucs.select(F.split("grp", " ")[0].cast("double").alias("max_df"), F.lit(int(n_gram)).alias("ngram_max"), "penalty", "c", "roc_auc")
        out = part if out is None else out.unionByName(part)
    return out.filter("roc_auc IS NOT NULL").groupBy("max_df", "ngram_max", "penalty", "c").agg(F.avg("roc_auc").alias("roc_auc"))


def best_setting(grid: DataFrame) -> dict | None:
    """The row with the highest score (ties: the first in the order of the settings); none without rows."""
    best = grid.orderBy(F.desc("roc_auc"), "max_df", "ngram_max", "penalty", "c").first()
    return {k: best[k] for k in ("max_df", "ngram_max", "penalty", "c")} if best else None


def search_text_classifier(train: DataFrame, text_col: str, label_col: str, fold_col: str = "fold", tfidf: bool = False, **search):
    """(model, grid): the best setting of the search refitted on all rows with a label."""
    grid = grid_search(train, text_col, label_col, fold_col, tfidf=tfidf, **search).persist()
    best = best_setting(grid)
    model = train_text_classifier(train, text_col, label_col, tfidf=tfidf, **best) if best else None
    return model, grid


# op 81
def embedding_classifier(train: DataFrame, vec_col: str, label_col: str, c: float = 1.0, penalty: str = "l2"):
    """Logistic regression on a supplied dense vector column (array<float> or vector)."""
    from pyspark.ml.functions import array_to_vector

    d = train.filter(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull())
    d = d.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"), F.col(label_col).cast("double").alias("label"))
    n = d.count()
    return _reloaded(_lr(c, n, penalty).fit(d)) if n else None


def predict_embedding(model, df: DataFrame, vec_col: str, out_prob: str = "prob", out_pred: str = "pred") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return df.withColumns({out_prob: F.lit(0.0), out_pred: F.lit(0)})
    cols = df.columns
    x = df.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))
    p = model.transform(x).withColumn(out_prob, vector_to_array("probability")[1])
    return p.select(*cols, out_prob).withColumn(out_pred, (F.col(out_prob) >= 0.5).cast("int"))


# op 79
def patient_meta_model(train: DataFrame, val: DataFrame, feature_cols: list[str], label_col: str) -> DataFrame:
    """Scale without centring + class-balanced logistic regression on patient features
    (null -> 0), threshold 0.5; returns ``val`` with ``meta_prob`` and ``meta_pred``."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def prep(df):
        return df.fillna(0.0, subset=feature_cols).withColumn("label", F.col(label_col).cast("double"))

    tr = prep(train)
    counts = tr.groupBy("label").agg(F.count(F.lit(1)).alias("_nc"))
    tot = tr.agg(F.count(F.lit(1)).alias("_n"))
    w = counts.select("label", (tot.select("_n").scalar() / (2.0 * F.col("_nc"))).alias("_w"))
    tr = tr.join(F.broadcast(w), on="label", how="left")  # w: one row per class
    n = tot.collect()[0][0] or 1
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=feature_cols, outputCol="_x"),
        StandardScaler(inputCol="_x", outputCol="features", withMean=False, withStd=True),
        _lr(1.0, n, "l2", weight_col="_w"),
    ])
    *scaling, fitted = pipe.fit(tr).stages
    m = PipelineModel(stages=[*scaling, _reloaded(fitted)])
    cols = val.columns
    p = m.transform(prep(val)).withColumn("meta_prob", vector_to_array("probability")[1])
    return p.select(*cols, "meta_prob").withColumn("meta_pred", (F.col("meta_prob") >= 0.5).cast("int"))
