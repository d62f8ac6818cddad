"""Evaluation metrics (ops 37-46, 57, 85).

Design: the input is reduced once to a *score histogram*
``(keys, y, yhat, s, cnt)`` by a partially-aggregated ``groupBy`` (one shuffle
of at most one row per distinct value per partition).  Every metric is then
computed from that histogram:

* confusion counts, Brier score: sums over the histogram;
* ECE / reliability table: the histogram grouped by calibration bin;
* average precision: distinct scores per key, cumulative sums by descending
  score computed in two levels (score buckets, then within a bucket) so that no
  single task ever holds all distinct scores of a key.

Keys are the evaluation dimensions (dataset, report column, prediction type,
level, group ...): one pass evaluates all of them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import stats

CALIBRATION_BINS = 10
#: Ranges of distinct scores per key, precision of their bounds, tasks that a key's scores are spread over.
AP_BUCKETS, AP_ACCURACY, AP_SALTS = 128, 10_000, 16

METRIC_COLUMNS = [
    "n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "specificity", "npv", "f1", "mcc",
    "accuracy_lo", "accuracy_hi", "precision_lo", "precision_hi", "recall_lo", "recall_hi",
    "specificity_lo", "specificity_hi", "npv_lo", "npv_hi", "pr_auc", "brier", "ece",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- #
# Histogram                                                                   #
# --------------------------------------------------------------------------- #
def score_histogram(df: DataFrame, keys: list[str], label: str, pred: str, prob: str | None = None) -> DataFrame:
    """Rows with complete (label, pred[, prob]) reduced to counts per (keys, y, yhat, s)."""
    need = _c(label).isNotNull() & _c(pred).isNotNull()
    if prob is not None:
        need = need & _c(prob).isNotNull()
    s = _c(prob).cast("double") if prob is not None else F.lit(None).cast("double")
    return (
        df.filter(need)
        .groupBy(*keys, _c(label).cast("int").alias("y"), _c(pred).cast("int").alias("yhat"), s.alias("s"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


# --------------------------------------------------------------------------- #
# op 37 / 38 / 39                                                             #
# --------------------------------------------------------------------------- #
def confusion_from_hist(hist: DataFrame, keys: list[str]) -> DataFrame:
    y, yh, cnt = F.col("y"), F.col("yhat"), F.col("cnt")
    return hist.groupBy(*keys).agg(
        F.sum(cnt).alias("n"),
        F.sum(F.when((y == 1) & (yh == 1), cnt).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (yh == 1), cnt).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (yh == 0), cnt).otherwise(0)).alias("fn"),
        F.sum(F.when((y == 0) & (yh == 0), cnt).otherwise(0)).alias("tn"),
        F.sum(cnt * (F.col("s") - y) * (F.col("s") - y)).alias("_sse"),
    )


def confusion(df: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """tn, fp, fn, tp (and n) per key."""
    return confusion_from_hist(score_histogram(df, keys, label, pred), keys).drop("_sse")


def classification_metrics(counts: DataFrame, alpha: float = 0.05, zero_division: str = "report") -> DataFrame:
    """Add accuracy, precision, recall, specificity, NPV, F1, MCC and Wilson bounds to count rows.

    0/0: precision, recall, F1, MCC -> 0; specificity, NPV -> null
    (``zero_division='zero'`` gives 0 for those too, the fairness convention).
    """
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    sn_zero = 0.0 if zero_division == "zero" else None
    acc = stats.wilson(tp + tn, n, alpha)
    prec = stats.wilson(tp, tp + fp, alpha)
    rec = stats.wilson(tp, tp + fn, alpha)
    spec = stats.wilson(tn, tn + fp, alpha)
    npv = stats.wilson(tn, tn + fn, alpha)
    return counts.withColumns(
        {
            "accuracy": stats.ratio(tp + tn, n),
            "precision": stats.ratio(tp, tp + fp, 0.0),
            "recall": stats.ratio(tp, tp + fn, 0.0),
            "specificity": stats.ratio(tn, tn + fp, sn_zero),
            "npv": stats.ratio(tn, tn + fn, sn_zero),
            "f1": stats.f1(tp, fp, fn),
            "mcc": stats.mcc(tp, fp, fn, tn),
            "accuracy_lo": acc[1], "accuracy_hi": acc[2],
            "precision_lo": prec[1], "precision_hi": prec[2],
            "recall_lo": rec[1], "recall_hi": rec[2],
            "specificity_lo": spec[1], "specificity_hi": spec[2],
            "npv_lo": npv[1], "npv_hi": npv[2],
        }
    )


def wilson_ci(df: DataFrame, k: str, n: str, alpha: float = 0.05, prefix: str = "") -> DataFrame:
    p, lo, hi = stats.wilson(k, n, alpha)
    return df.withColumns({f"{prefix}p": p, f"{prefix}lo": lo, f"{prefix}hi": hi})


# --------------------------------------------------------------------------- #
# op 41 average precision                                                     #
# --------------------------------------------------------------------------- #
def average_precision_from_hist(hist: DataFrame, keys: list[str], buckets: int = AP_BUCKETS) -> DataFrame:
    """AP = sum over distinct scores (descending) of (pos_i / P) * precision at that score.

    Null unless the key has both classes.  Distinct scores are dealt to ranges of about equal
    numbers, whatever their scale: the bounds are quantiles per key from a mergeable sketch.  Range
    totals give running offsets and the class totals through windows over the small
    table of ranges; running sums inside a range use a window per (key, range).
    """
    y, cnt = F.col("y"), F.col("cnt")
    per_s = hist.groupBy(*keys, "s").agg(F.sum(y * cnt).alias("pos"), F.sum(cnt).alias("m"))
    # Bounds meet their scores by key and a small salt, so no task joins all scores of a key.
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = per_s.groupBy(*keys).agg(F.percentile_approx("s", cuts, AP_ACCURACY).alias("_cuts"))
    bounds = bounds.select(*keys, "_cuts", F.explode(F.sequence(F.lit(0), F.lit(AP_SALTS - 1))).alias("_salt"))
    salted = per_s.filter("s IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("s"), F.lit(AP_SALTS)).cast("int"))
    ps = salted.join(bounds, on=[*keys, "_salt"], how="inner")
    ps = ps.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("s")))).drop("_cuts", "_salt")
    # level 1: bucket totals, running offset from higher buckets, class totals (tiny table).
    bt = ps.groupBy(*keys, "_b").agg(F.sum("pos").alias("_bpos"), F.sum("m").alias("_bm"))
    wb = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wk = Window.partitionBy(*keys)
    bt = bt.select(
        *keys, "_b",
        F.coalesce(F.sum("_bpos").over(wb), F.lit(0)).alias("_opos"),
        F.coalesce(F.sum("_bm").over(wb), F.lit(0)).alias("_om"),
        F.sum("_bpos").over(wk).alias("_P"),
        F.sum("_bm").over(wk).alias("_N"),
    )
    # level 2: running sums inside a bucket, by descending score.
    ws = Window.partitionBy(*keys, "_b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = ps.join(bt, on=[*keys, "_b"], how="inner").select(
        *keys, "pos", "_P", "_N",
        (F.col("_opos") + F.sum("pos").over(ws)).alias("_cpos"),
        (F.col("_om") + F.sum("m").over(ws)).alias("_cm"),
    )
    # guarded inside the sum: with ANSI arithmetic a single-class key would divide by zero
    term = F.when(F.col("_P") > 0, F.col("pos").cast("double") / F.col("_P") * (F.col("_cpos").cast("double") / F.col("_cm")))
    return cum.groupBy(*keys).agg(
        F.when((F.first("_P") > 0) & (F.first("_P") < F.first("_N")), F.sum(term)).alias("pr_auc")
    )


def average_precision(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    return average_precision_from_hist(score_histogram(df, keys, label, label, score), keys)


def roc_auc_by(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """ROC-AUC per key: chance that a positive scores above a negative, ties half; null with one class only.

    Rows become counts per distinct score first; the running sums over these are per key.
    """
    hist = df.filter(F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(label)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_q", F.col("_n") - F.col("_p"))
    below = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_below", F.coalesce(F.sum("_q").over(below), F.lit(0.0)))
    pos, neg = F.sum("_p"), F.sum("_q")
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2.0))
    return hist.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), wins / F.when(pos * neg > 0, pos * neg)).alias("roc_auc"))


# --------------------------------------------------------------------------- #
# op 42 / 85 calibration                                                      #
# --------------------------------------------------------------------------- #
def calibration_bin(s, bins: int = CALIBRATION_BINS) -> Column:
    """Right-closed uniform bins on [0, 1]: bin k holds (k/bins, (k+1)/bins], 0 in bin 0.

    Edges are ``k * (1/bins)`` in double precision, the usual linspace values.
    """
    s = _c(s)
    step = 1.0 / bins
    return sum((s > F.lit(k * step)).cast("int") for k in range(1, bins))


def reliability_from_hist(hist: DataFrame, keys: list[str], bins: int = CALIBRATION_BINS) -> DataFrame:
    cnt = F.col("cnt")
    return hist.groupBy(*keys, calibration_bin("s", bins).alias("bin")).agg(
        F.sum(cnt).alias("bin_n"),
        (F.sum(F.col("y") * cnt) / F.sum(cnt)).alias("frac_pos"),
        (F.sum(F.col("s") * cnt) / F.sum(cnt)).alias("mean_score"),
    )


def reliability_table(df: DataFrame, keys: list[str], label: str, score: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Observed share vs mean score per bin (the table behind a calibration plot)."""
    return reliability_from_hist(score_histogram(df, keys, label, label, score), keys, bins)


def ece_from_hist(hist: DataFrame, keys: list[str], bins: int = CALIBRATION_BINS) -> DataFrame:
    rel = reliability_from_hist(hist, keys, bins)
    return rel.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("frac_pos") - F.col("mean_score")) * F.col("bin_n")) / F.sum("bin_n")).alias("ece")
    )


def brier_ece(df: DataFrame, keys: list[str], label: str, score: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    h = score_histogram(df, keys, label, label, score)
    b = h.groupBy(*keys).agg((F.sum(F.col("cnt") * (F.col("s") - F.col("y")) ** 2) / F.sum("cnt")).alias("brier"))
    return b.join(ece_from_hist(h, keys, bins), on=keys, how="left")


# --------------------------------------------------------------------------- #
# op 44 / 45 / 46                                                             #
# --------------------------------------------------------------------------- #
def evaluate(
    df: DataFrame, keys: list[str], label: str, pred: str, prob: str | None = None,
    total: int | Column | None = None, alpha: float = 0.05,
) -> DataFrame:
    """One evaluation row per key: counts, metrics, Wilson bounds, AP, Brier, ECE, coverage.

    Rows with a null label, prediction or (if given) score are left out first.
    PR-AUC, Brier and ECE need a score and both classes, else null.
    """
    hist = score_histogram(df, keys, label, pred, prob)
    conf = confusion_from_hist(hist, keys)
    two = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    if prob is not None:
        # merge the per-key tables by union + groupBy, not joins: no join condition to
        # fold away when a key is a constant, and no shuffle of anything but key rows
        ap = average_precision_from_hist(hist, keys)
        ece = ece_from_hist(hist, keys)
        parts = conf.unionByName(ap, allowMissingColumns=True).unionByName(ece, allowMissingColumns=True)
        vals = [c for c in parts.columns if c not in keys]
        merged = parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in vals])
        counts = classification_metrics(merged, alpha).withColumn("brier", F.when(two, F.col("_sse") / F.col("n")))
        out = counts.withColumns({"pr_auc": F.when(two, F.col("pr_auc")), "ece": F.when(two, F.col("ece"))})
    else:
        counts = classification_metrics(conf, alpha)
        out = counts.withColumns({c: F.lit(None).cast("double") for c in ("pr_auc", "brier", "ece")})
    out = out.drop("_sse")
    if total is not None:
        t = total if isinstance(total, Column) else F.lit(total)
        out = out.withColumn("coverage_pct", stats.ratio(F.col("n") * 100.0, t))
    return out.select(*keys, *METRIC_COLUMNS, *(["coverage_pct"] if total is not None else []))


def coverage(df: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """Rows per key, rows usable for evaluation (label and prediction present), and their share in %."""
    ok = F.col(label).isNotNull() & F.col(pred).isNotNull()
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("n"))
    return g.withColumn("coverage_pct", stats.ratio(F.col("n") * 100.0, F.col("total")))


def per_class_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted averages (op 57)."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def f1(p, r):
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))

    p1, r1 = stats.ratio(tp, tp + fp, 0.0), stats.ratio(tp, tp + fn, 0.0)
    p0, r0 = stats.ratio(tn, tn + fn, 0.0), stats.ratio(tn, tn + fp, 0.0)
    s1, s0 = tp + fn, tn + fp
    rows = F.array(
        F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f1(p0, r0).alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1(p1, r1).alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), stats.ratio(tp + tn, n).alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f1(p0, r0) + f1(p1, r1)) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f1(p0, r0) * s0 + f1(p1, r1) * s1) / n).alias("f1"),
                 n.alias("support")),
    )
    return counts.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for stable value comparison)."""
    return df.select(
        *[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
          for f in df.schema.fields]
    )


# op 45
def evaluate_model(
    df: DataFrame, keys: list[str], label: str, pred: str, prob: str | None = None, total_col: str | None = None,
    bootstrap: bool = False, n_boot: int = 1000, seed: int = 0, dataset: str | None = None, report_col: str | None = None, pred_type: str = "",
) -> DataFrame:
    """One report row per key with the original field names and formatted strings.

    Percentages carry Wilson intervals; F1, MCC and PR-AUC carry bootstrap intervals when
    ``bootstrap`` is set (else ``CI: N/A``); a null value prints as ``N/A``.
    ``total_col`` names a per-key denominator for the coverage percentage.  With ``dataset`` or ``report_col``
    (names of key columns) the row has all 18 fields, the six that say what was evaluated in place of the keys.
    """
    from cohortspark.functions import fmt as FM

    ev = evaluate(df, keys, label, pred, prob)
    bounds = [f"{m}_{e}" for m in ("f1", "mcc", "pr_auc") for e in ("lo", "hi")]
    if bootstrap:
        from cohortspark.operators.bootstrap import bootstrap_ci, bootstrap_pr_auc

        b = bootstrap_ci(ev.select(*keys, "tp", "fp", "fn", "tn"), keys, ("f1", "mcc"), n_boot, seed).select(*keys, "metric", "lo", "hi")
        if prob is not None:
            usable = df.filter(F.col(pred).isNotNull())
            b = b.unionByName(bootstrap_pr_auc(usable, keys, label, prob, n_boot, seed).select(*keys, F.lit("pr_auc").alias("metric"), "lo", "hi"))
        piv = b.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == c[:-3], F.col(c[-2:]))).alias(c) for c in bounds])
        ev = ev.join(piv, on=keys, how="left")
    else:
        ev = ev.withColumns({c: F.lit(None).cast("double") for c in bounds})
    if total_col is not None:
        tot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")) if total_col == "rows" else df.groupBy(*keys).agg(F.max(total_col).alias("_total"))
        ev = ev.join(tot, on=keys, how="left")
        cov = F.format_string("%.2f%%", F.col("n") * 100.0 / F.col("_total"))
    else:
        cov = F.lit("")
    said = keys
    if dataset or report_col:
        name = lambda c: F.col(c).cast("string") if c else F.lit("")
        said = [
            name(dataset).alias("Dataset"), name(report_col).alias("Report_Column"), F.lit(label).alias("Gold_Standard_Column"),
            F.lit(pred_type).alias("Prediction_Type"), F.lit("").alias("Demographic_Attribute"), F.lit("").alias("Group"),
        ]
    return ev.select(
        *said,
        FM.pct_ci("accuracy", "accuracy_lo", "accuracy_hi").alias("Accuracy"),
        FM.pct_ci("precision", "precision_lo", "precision_hi").alias("Precision"),
        FM.pct_ci("recall", "recall_lo", "recall_hi").alias("Recall"),
        FM.pct_ci("specificity", "specificity_lo", "specificity_hi").alias("Specificity"),
        FM.pct_ci("npv", "npv_lo", "npv_hi").alias("NPV"),
        FM.pct_ci("f1", "f1_lo", "f1_hi").alias("F1_Score"),
        FM.num_ci("mcc", "mcc_lo", "mcc_hi").alias("MCC"),
        FM.pct_ci("pr_auc", "pr_auc_lo", "pr_auc_hi").alias("PR_AUC"),
        FM.num("brier").alias("Brier_Score"),
        FM.num("ece").alias("ECE"),
        F.col("n").alias("Coverage_Count"),
        cov.alias("Coverage_Pct"),
    )
