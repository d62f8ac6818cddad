"""Document-to-patient study tables (ops 55, 56, 59, 77, 78).

Correlations and the Gram matrix are single aggregations over the data; only
k x k matrices (k = number of report flags) reach the driver for inversion.
Model fits collapse the rows to the <= 2^k distinct flag patterns with a count
used as instance weight, so the fit's input is bounded by 2^k whatever the data.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.session import saved_table


# op 59
def sample_size_check(
    df: DataFrame, attrs: list[str], label: str, r2: float = 0.05, predictors: int = 4, shrinkage: float = 0.9,
) -> DataFrame:
    """Per (attribute, group): n, prevalence and the needed sample size
    ``predictors / (shrinkage * -ln(1 - r2)) / (prevalence * (1 - prevalence))``."""
    from cohortspark.operators.fairness import unpivot_attributes

    long = unpivot_attributes(df, [], attrs, [label]).filter(F.col(label).isNotNull())
    g = long.groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("prevalence"))
    eff = predictors / (shrinkage * -math.log(1.0 - r2))
    phi = F.col("prevalence")
    return g.withColumn("needed_n", F.when((phi > 0) & (phi < 1), F.lit(eff) / (phi * (1 - phi))))


def required_sample_size(r2: float, predictors: int, shrinkage: float, prevalence: float) -> float:
    return predictors / (shrinkage * -math.log(1.0 - r2)) / (prevalence * (1.0 - prevalence))


def _corr(a: str, b: str):
    """Pearson correlation of two columns; null where one of them does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


# op 55
def label_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over complete rows, long form (a, b, corr)."""
    d = df.dropna(subset=cols)
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    row = d.agg(*[_corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


# op 56
def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factor per feature: the diagonal of the inverse correlation matrix.

    One aggregation computes all pairwise correlations; the k x k inversion
    happens on the driver (k = number of features).
    """
    import numpy as np

    d = df.dropna(subset=cols)
    k = len(cols)
    aggs = [_corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1, k)]
    r = d.agg(*aggs).collect()[0] if aggs else {}
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            v = r[f"c{i}_{j}"]
            m[i, j] = m[j, i] = float("nan") if v is None else v
    try:
        inv = np.linalg.inv(m)
        vals = [float(inv[i, i]) for i in range(k)]
    except np.linalg.LinAlgError:
        vals = [float("inf")] * k
    spark = df.sparkSession
    return spark.createDataFrame(list(zip(cols, vals)), "feature string, vif double")


def flag_patterns(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Collapse rows to distinct (features, label) patterns with a ``weight`` count (<= 2^(k+1) rows).

    The patterns are saved: fits pass over them many times, over the rows behind them once."""
    d = df.dropna(subset=[*features, label])
    patterns = d.groupBy(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return saved_table(patterns.coalesce(1), "patterns")  # some rows of flags


# op 77
def odds_ratios(df: DataFrame, features: list[str], label: str, c: float = 1.0) -> DataFrame:
    """Label ~ flags with L1 and L2 penalties: coefficient and exp(coefficient) per feature.

    Spark averages the loss over rows and leaves the intercept unpenalised, so the
    penalty strength maps to ``regParam = 1 / (C * n)`` with no standardisation.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    schema = "penalty string, feature string, coefficient double, odds_ratio double"
    pats = flag_patterns(df, features, label)
    n = pats.agg(F.sum("weight")).collect()[0][0]
    if not n:  # no complete row
        return df.sparkSession.createDataFrame([], schema)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(pats)
    rows = []
    for name, enet in (("l1", 1.0), ("l2", 0.0)):
        lr = LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * n),
            elasticNetParam=enet, standardization=False, maxIter=200,
        )
        m = lr.fit(data)
        for f, w in zip(features, m.coefficients.toArray()):
            rows.append((name, f, float(w), float(math.exp(w))))
        rows.append((name, "intercept", float(m.intercept), float(math.exp(m.intercept))))
    return df.sparkSession.createDataFrame(rows, schema)


# op 78
def label_tree(df: DataFrame, features: list[str], label: str, max_depth: int | None = None, seed: int = 0) -> DataFrame:
    """Decision tree label ~ flags on the weighted pattern table; accuracy and sorted importances.

    Unless ``max_depth`` is given, the tree may ask for every flag on a path.
    """
    return fit_label_tree(df, features, label, max_depth, seed)[0]


def fit_label_tree(df: DataFrame, features: list[str], label: str, max_depth: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the table of ``label_tree``, the tree's own counts n, tp, fp, fn, tn on the rows it was fitted on).

    Rows of one class give a tree of one leaf; no rows give no counts and no table.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    pats = flag_patterns(df, features, label)
    classes = sorted(r["label"] for r in pats.select("label").distinct().collect())  # a row per class
    if len(classes) < 2:
        pred, weights = pats.withColumn("prediction", F.col("label")), [0.0] * len(features)
    else:
        data = VectorAssembler(inputCols=features, outputCol="features").transform(pats)
        m = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=max_depth or min(30, len(features)), seed=seed).fit(data)
        pred, weights = m.transform(data), m.featureImportances.toArray()
    hits = lambda y, p: F.sum(F.when((F.col("label") == y) & (F.col("prediction") == p), F.col("weight")).otherwise(0.0)).cast("long")
    counts = pred.groupBy(F.lit("all").alias("k")).agg(
        F.sum("weight").cast("long").alias("n"), hits(1, 1).alias("tp"), hits(0, 1).alias("fp"), hits(1, 0).alias("fn"), hits(0, 0).alias("tn")
    ).drop("k")
    if not classes:
        return df.sparkSession.createDataFrame([], "kind string, feature string, value double"), counts
    acc = pred.agg((F.sum(F.when(F.col("prediction") == F.col("label"), F.col("weight")).otherwise(0.0)) / F.sum("weight"))).collect()[0][0]
    imp = sorted(zip(features, weights), key=lambda t: -t[1])
    rows = [("importance", f, float(v)) for f, v in imp] + [("accuracy", None, float(acc or 0.0))]
    return df.sparkSession.createDataFrame(rows, "kind string, feature string, value double"), counts
