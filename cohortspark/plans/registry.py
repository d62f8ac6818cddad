"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the driver's tables whole (``sf_dir``) and returns a lazy
DataFrame; ``oracle_sql()`` gives an independent SQL formulation where the
operator is SQL-expressible.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import metrics as M
from cohortspark.operators import prep as P
from cohortspark.operators import rollup as R
from cohortspark.plans import cohorts as C
from cohortspark.plans import fixture as FX
from cohortspark.plans import oracle as O
from cohortspark.sources import testdata_view as TV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def reports(spark: SparkSession, sf: str, with_text: bool = True) -> DataFrame:
    return P.prepare_reports(TV.report_view(spark, sf, with_text))


def r6(df: DataFrame) -> DataFrame:
    return M.round_doubles(df, 6)


W = f"WITH {O.PREPARED_CTE}"
DEMO = FX.DEMOGRAPHICS

# --------------------------------------------------------------------------- #
# Sources and preprocessing                                                   #
# --------------------------------------------------------------------------- #
REPORT_COLS = [
    "doc_id", "study_id", "visit_id", "report_col", "ord", "text", "gold", "gold_alt", "gender",
    "ethnicity", "age_group", "imd_group", "split", "split_leaky",
]


@register("load_reports", f"{W} SELECT {', '.join(REPORT_COLS)} FROM prepared")
def q_load_reports(spark, sf):
    return reports(spark, sf).select(*REPORT_COLS)


@register(
    "map_category",
    f"{W} SELECT r.doc_id, r.ethnicity_raw, COALESCE(m.grp, 'Not Asked') AS ethnicity "
    f"FROM reports r LEFT JOIN ethmap m ON lower(r.ethnicity_raw) = m.raw",
)
def q_map_category(spark, sf):
    from cohortspark import defaults

    v = TV.report_view(spark, sf, with_text=False).select("doc_id", "ethnicity_raw")
    return P.map_category(v, "ethnicity_raw", defaults.ethnicity_map_df(spark), defaults.ETHNICITY_DEFAULT, out="ethnicity")


@register("bin_age", f"{W} SELECT doc_id, age, age_group FROM prepared")
def q_bin_age(spark, sf):
    return reports(spark, sf, False).select("doc_id", "age", "age_group")


@register("bin_imd", f"{W} SELECT doc_id, imd, imd_group FROM prepared")
def q_bin_imd(spark, sf):
    return reports(spark, sf, False).select("doc_id", "imd", "imd_group")


def _fmt_sql(x: str) -> str:
    s = f"CAST(CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS BIGINT) AS VARCHAR)"
    return f"COALESCE(CASE WHEN length({s}) < 7 THEN lpad({s}, 7, '0') ELSE {s} END, 'NaN')"


_STUDY_TXT = "CAST(study_id AS VARCHAR) || '.0'"


@register(
    "format_id",
    f"{W} SELECT doc_id, {_fmt_sql(_STUDY_TXT)} AS patient_number, "
    f"{_fmt_sql('age * 1000000 + doc_id')} AS long_number, {_fmt_sql('report_col')} AS not_a_number FROM reports",
)
def q_format_id(spark, sf):
    v = TV.report_view(spark, sf, False)
    return v.select(
        "doc_id",
        P.format_id(F.concat(F.col("study_id").cast("string"), F.lit(".0"))).alias("patient_number"),
        P.format_id(F.col("age") * 1000000 + F.col("doc_id")).alias("long_number"),
        P.format_id("report_col").alias("not_a_number"),
    )


_COERCE_SRC = "CASE WHEN doc_id % 7 = 0 THEN 'NaN' WHEN doc_id % 7 = 1 THEN 'unknown' ELSE CAST(gold AS VARCHAR) END"


@register(
    "coerce_labels",
    f"{W} SELECT doc_id, TRY_CAST(NULLIF(trim({_COERCE_SRC}), 'NaN') AS DOUBLE) AS label FROM reports",
)
def q_coerce_labels(spark, sf):
    v = TV.report_view(spark, sf, False)
    raw = (
        F.when(F.col("doc_id") % 7 == 0, F.lit("NaN"))
        .when(F.col("doc_id") % 7 == 1, F.lit("unknown"))
        .otherwise(F.col("gold").cast("string"))
    )
    return v.select("doc_id", P.coerce_label(raw).alias("label"))


def _wide(spark, sf) -> DataFrame:
    """Visit-wide form: one row per (study_id, visit_id), one text column per report slot."""
    v = TV.report_view(spark, sf)
    return v.groupBy("study_id", "visit_id").pivot("report_col", TV.REPORT_SLOTS).agg(F.max("text"))


_WIDE_SQL = (
    "wide AS (SELECT study_id, visit_id, "
    + ", ".join(f"MAX(CASE WHEN report_col = {O.q(s)} THEN text END) AS {s}" for s in TV.REPORT_SLOTS)
    + " FROM reports GROUP BY study_id, visit_id)"
)


@register(
    "combine_text",
    f"{W}, {_WIDE_SQL} SELECT study_id, visit_id, concat_ws(' ', "
    + ", ".join(f"COALESCE({s}, '')" for s in TV.REPORT_SLOTS)
    + ") AS combined_text FROM wide",
)
def q_combine_text(spark, sf):
    return P.combine_text(_wide(spark, sf), TV.REPORT_SLOTS, "combined_text").select("study_id", "visit_id", "combined_text")


@register(
    "doc_digest",
    f"{W}, {_WIDE_SQL} SELECT study_id, visit_id, md5(concat_ws(' ', "
    + ", ".join(f"COALESCE({s}, 'nan')" for s in TV.REPORT_SLOTS)
    + ")) AS doc_digest FROM wide",
)
def q_doc_digest(spark, sf):
    return _wide(spark, sf).select("study_id", "visit_id", P.doc_digest(TV.REPORT_SLOTS).alias("doc_digest"))


_WIDE_LABEL_SQL = (
    "wl AS (SELECT study_id, visit_id, "
    + ", ".join(f"MAX(CASE WHEN report_col = {O.q(s)} THEN gold_alt END) AS {s}" for s in TV.REPORT_SLOTS)
    + " FROM reports GROUP BY study_id, visit_id)"
)


@register(
    "derive_patient_label",
    f"{W}, {_WIDE_LABEL_SQL} SELECT study_id, visit_id, GREATEST(" + ", ".join(TV.REPORT_SLOTS) + ") AS Patient_Has_IBD FROM wl",
)
def q_derive_patient_label(spark, sf):
    v = TV.report_view(spark, sf, False)
    wl = v.groupBy("study_id", "visit_id").pivot("report_col", TV.REPORT_SLOTS).agg(F.max("gold_alt"))
    return P.derive_patient_label(wl, TV.REPORT_SLOTS, "Patient_Has_IBD").select("study_id", "visit_id", "Patient_Has_IBD")


@register(
    "drop_incomplete",
    f"{W} SELECT doc_id, gold, gold_alt FROM reports WHERE text IS NOT NULL AND gold IS NOT NULL",
)
def q_drop_incomplete(spark, sf):
    v = TV.report_view(spark, sf).select("doc_id", "text", "gold", "gold_alt")
    return P.drop_incomplete(v, ["text", "gold"]).select("doc_id", "gold", "gold_alt")


@register(
    "null_label_as_group",
    f"{W} SELECT doc_id, COALESCE(CAST(imd_group AS VARCHAR), 'nan') AS imd_group, "
    "COALESCE(CAST(age_group AS VARCHAR), 'nan') AS age_group FROM prepared",
)
def q_null_label_as_group(spark, sf):
    v = reports(spark, sf, False)
    return v.select("doc_id", P.null_label_as_group("imd_group").alias("imd_group"), P.null_label_as_group("age_group").alias("age_group"))


# --------------------------------------------------------------------------- #
# Matching, roll-ups                                                          #
# --------------------------------------------------------------------------- #
@register("regex_flag", f"{W}, {O.flagged_cte()} SELECT doc_id, report_col, pred_a, pred_b, pred FROM flagged")
def q_regex_flag(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    return f.select("doc_id", "report_col", "pred_a", "pred_b", "pred")


@register(
    "regex_flags_all",
    f"{W}, {O.flagged_cte()} SELECT doc_id, 'A' AS category, pred_a AS pred FROM flagged "
    "UNION ALL SELECT doc_id, 'B' AS category, pred_b AS pred FROM flagged",
)
def q_regex_flags_all(spark, sf):
    from cohortspark.operators import match as MT

    v = TV.report_view(spark, sf).select("doc_id", "text")
    return MT.regex_flags_long(v, FX.vocab_df(spark), "text", whole_word=True)


@register(
    "cumulative_or",
    f"{W}, {O.flagged_cte()}, {O.levels_cte()} SELECT dataset, study_id, visit_id, pred, prob, gold FROM visits",
)
def q_cumulative_or(spark, sf):
    run = C.regex_cohort(reports(spark, sf), FX.vocab_df(spark), FX.LABEL)
    return r6(run["visits"].select("dataset", "study_id", "visit_id", "pred", "prob", "gold"))


@register(
    "collapse_patients",
    f"{W}, {O.flagged_cte()}, {O.levels_cte(demo=DEMO)} SELECT dataset, study_id, pred, prob, gold, "
    + ", ".join(DEMO) + " FROM patients",
)
def q_collapse_patients(spark, sf):
    run = C.regex_cohort(reports(spark, sf), FX.vocab_df(spark), FX.LABEL, DEMO)
    return r6(run["patients"].select("dataset", "study_id", "pred", "prob", "gold", *DEMO))


@register(
    "patient_gold",
    f"{W} SELECT study_id, CAST(COALESCE(MAX(gold_alt), 0) AS INTEGER) AS patient_gold FROM reports GROUP BY study_id",
)
def q_patient_gold(spark, sf):
    return R.patient_gold(TV.report_view(spark, sf, False), ["gold_alt"], "study_id")


@register(
    "regex_cohort",
    f"{W}, {O.flagged_cte()}, {O.levels_cte()}, {O.evaluate_sql('alllevels', C.LEVEL_COLS)} "
    f"SELECT {', '.join(C.LEVEL_COLS)}, {O.EVAL_OUT} FROM evaluation",
)
def q_regex_cohort(spark, sf):
    run = C.regex_cohort(reports(spark, sf, False), FX.vocab_df(spark), FX.LABEL, texts=TV.text_view(spark, sf))
    return r6(run["evaluation"])


# --------------------------------------------------------------------------- #
# Metrics                                                                     #
# --------------------------------------------------------------------------- #
DOC_KEYS = ["split", "report_col"]


@register(
    "confusion",
    f"{W}, {O.flagged_cte()}, {O.evaluate_sql('(SELECT split, report_col, gold_alt AS gold, pred, prob FROM flagged)', DOC_KEYS)} "
    "SELECT split, report_col, n, tp, fp, fn, tn FROM evaluation",
)
def q_confusion(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    return M.confusion(f, DOC_KEYS, FX.LABEL, "pred")


@register(
    "classification_metrics",
    f"{W}, {O.flagged_cte()}, {O.evaluate_sql('(SELECT split, report_col, gold_alt AS gold, pred, prob FROM flagged)', DOC_KEYS)} "
    "SELECT split, report_col, n, tp, fp, fn, tn, accuracy, precision, recall, specificity, npv, f1, mcc FROM evaluation",
)
def q_classification_metrics(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    m = M.classification_metrics(M.confusion(f, DOC_KEYS, FX.LABEL, "pred"))
    return r6(m.select(*DOC_KEYS, "n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "specificity", "npv", "f1", "mcc"))


@register(
    "wilson_ci",
    f"{W}, {O.flagged_cte()}, {O.evaluate_sql('(SELECT split, report_col, gold_alt AS gold, pred, prob FROM flagged)', DOC_KEYS)} "
    "SELECT split, report_col, tp + tn AS k, n, accuracy AS p, accuracy_lo AS lo, accuracy_hi AS hi FROM evaluation",
)
def q_wilson_ci(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    c = M.confusion(f, DOC_KEYS, FX.LABEL, "pred").withColumn("k", F.col("tp") + F.col("tn"))
    return r6(M.wilson_ci(c, "k", "n").select(*DOC_KEYS, "k", "n", "p", "lo", "hi"))


def _hits_score(text_col: str = "text"):
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    hits = F.size(F.filter(toks, lambda t: t.isin("thre", "eron")))
    return F.least(F.lit(1.0), hits.cast("double") / F.lit(5.0))


_HITS_SQL = (
    "LEAST(1.0, CAST(len(list_filter(regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]+'), "
    "lambda t: t IN ('thre', 'eron'))) AS DOUBLE) / 5.0)"
)
SCORED_SQL = f"scored AS (SELECT *, {_HITS_SQL} AS score FROM prepared)"


def _scored(spark, sf) -> DataFrame:
    return reports(spark, sf).withColumn("score", _hits_score())


@register(
    "average_precision",
    f"{W}, {SCORED_SQL}, {O.evaluate_sql('(SELECT split, gold_alt AS gold, gold_alt AS pred, score AS prob FROM scored)', ['split'])} "
    "SELECT split, pr_auc FROM evaluation",
)
def q_average_precision(spark, sf):
    return r6(M.average_precision(_scored(spark, sf), ["split"], FX.LABEL, "score"))


@register(
    "brier_ece",
    f"{W}, {SCORED_SQL}, {O.evaluate_sql('(SELECT split, gold_alt AS gold, gold_alt AS pred, score AS prob FROM scored)', ['split'])} "
    "SELECT split, brier, ece FROM evaluation",
)
def q_brier_ece(spark, sf):
    return r6(M.brier_ece(_scored(spark, sf), ["split"], FX.LABEL, "score"))


@register(
    "reliability_table",
    f"{W}, {SCORED_SQL}, h AS (SELECT split, gold_alt AS y, score AS s FROM scored WHERE gold_alt IS NOT NULL) "
    f"SELECT split, {O._bin_sql('s')} AS bin, CAST(COUNT(*) AS BIGINT) AS bin_n, {O.r6('AVG(y)')} AS frac_pos, "
    f"{O.r6('AVG(s)')} AS mean_score FROM h GROUP BY ALL",
)
def q_reliability_table(spark, sf):
    return r6(M.reliability_table(_scored(spark, sf), ["split"], FX.LABEL, "score"))


@register(
    "evaluate",
    f"{W}, {SCORED_SQL}, {O.evaluate_sql('(SELECT split, report_col, gold_alt AS gold, CAST(score >= 0.4 AS INTEGER) AS pred, score AS prob FROM scored)', DOC_KEYS)} "
    f"SELECT split, report_col, {O.EVAL_OUT} FROM evaluation",
)
def q_evaluate(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("score") >= 0.4).cast("int"))
    return r6(M.evaluate(s, DOC_KEYS, FX.LABEL, "pred", "score"))


# --------------------------------------------------------------------------- #
# Fairness                                                                    #
# --------------------------------------------------------------------------- #
FKEYS = ["dataset", "pred_type"]
_FAIR_SRC = f"{W}, {O.flagged_cte()}, {O.levels_cte(demo=DEMO)}, {O.fairness_sql('patients', FKEYS, DEMO, FX.REFERENCE)}"


def _patients(spark, sf) -> DataFrame:
    return C.regex_cohort(reports(spark, sf, False), FX.vocab_df(spark), FX.LABEL, DEMO, texts=TV.text_view(spark, sf))["patients"]


def _fair(spark, sf) -> DataFrame:
    from cohortspark.operators import fairness as FA

    return FA.fairness_report(_patients(spark, sf), FKEYS, DEMO, "pred", "gold", FX.reference_df(spark))


FAIR_OUT = (
    "dataset, pred_type, attribute, level, grp, n, tp, fp, fn, tn, rate, tpr, dp_ref, demographic_parity, eo_ref, "
    "equal_opportunity, di_ref, disparate_impact, accuracy, precision, recall, specificity, npv, f1, mcc, accuracy_lo, "
    "accuracy_hi, precision_lo, precision_hi, recall_lo, recall_hi, specificity_lo, specificity_hi, npv_lo, npv_hi"
)


@register("fairness_report", f"{_FAIR_SRC} SELECT {FAIR_OUT} FROM fairness")
def q_fairness_report(spark, sf):
    return r6(_fair(spark, sf).select(*[c.strip() for c in FAIR_OUT.split(",")]))


@register("group_rates", f"{_FAIR_SRC} SELECT dataset, pred_type, attribute, grp, n, rate FROM fairness WHERE level = 'group'")
def q_group_rates(spark, sf):
    from cohortspark.operators import fairness as FA

    g = FA.group_rates(FA.group_counts(_patients(spark, sf), FKEYS, DEMO, "pred", "gold"))
    return r6(g.select(*FKEYS, "attribute", "grp", "n", "rate"))


@register("group_tpr", f"{_FAIR_SRC} SELECT dataset, pred_type, attribute, grp, tp, fn, tpr FROM fairness WHERE level = 'group'")
def q_group_tpr(spark, sf):
    from cohortspark.operators import fairness as FA

    g = FA.group_rates(FA.group_counts(_patients(spark, sf), FKEYS, DEMO, "pred", "gold"))
    return r6(g.select(*FKEYS, "attribute", "grp", "tp", "fn", "tpr"))


@register(
    "demographic_parity",
    f"{_FAIR_SRC} SELECT dataset, pred_type, attribute, grp, dp_ref, demographic_parity FROM fairness WHERE level = 'group'",
)
def q_demographic_parity(spark, sf):
    from cohortspark.operators import fairness as FA

    return r6(FA.demographic_parity(_patients(spark, sf), FKEYS, DEMO, "pred", "gold", FX.reference_df(spark)))


@register(
    "equal_opportunity",
    f"{_FAIR_SRC} SELECT dataset, pred_type, attribute, grp, eo_ref, equal_opportunity FROM fairness WHERE level = 'group'",
)
def q_equal_opportunity(spark, sf):
    from cohortspark.operators import fairness as FA

    return r6(FA.equal_opportunity(_patients(spark, sf), FKEYS, DEMO, "pred", "gold", FX.reference_df(spark)))


@register(
    "disparate_impact",
    f"{_FAIR_SRC} SELECT dataset, pred_type, attribute, grp, di_ref, disparate_impact FROM fairness WHERE level = 'group'",
)
def q_disparate_impact(spark, sf):
    from cohortspark.operators import fairness as FA

    return r6(FA.disparate_impact(_patients(spark, sf), FKEYS, DEMO, "pred", "gold", FX.reference_df(spark)))


@register(
    "join_reference_group",
    f"{_FAIR_SRC} SELECT DISTINCT dataset, pred_type, f.attribute, grp, r.ref_group FROM fairness f "
    "LEFT JOIN refs r ON f.attribute = r.attribute WHERE level = 'group'",
)
def q_join_reference_group(spark, sf):
    from cohortspark.operators import fairness as FA
    from cohortspark.operators.joins import bounded_broadcast

    g = FA.group_counts(_patients(spark, sf), FKEYS, DEMO, "pred", "gold")
    return g.join(bounded_broadcast(FX.reference_df(spark)), on="attribute", how="left").select(
        *FKEYS, "attribute", "grp", "ref_group"
    )


@register(
    "fairness_long",
    f"{_FAIR_SRC}, fl AS ("
    "SELECT dataset, pred_type, attribute, grp, 'Demographic_Parity' AS comparison, dp_ref AS reference, demographic_parity AS value FROM fairness WHERE level = 'group' "
    "UNION ALL SELECT dataset, pred_type, attribute, grp, 'Equal_Opportunity', eo_ref, equal_opportunity FROM fairness WHERE level = 'group' "
    "UNION ALL SELECT dataset, pred_type, attribute, grp, 'Disparate_Impact', di_ref, disparate_impact FROM fairness WHERE level = 'group') "
    "SELECT *, grp || ' vs ' || reference AS label FROM fl WHERE reference IS NOT NULL AND grp <> reference",
)
def q_fairness_long(spark, sf):
    from cohortspark.operators import fairness as FA

    return r6(FA.fairness_long(_fair(spark, sf), FKEYS))


@register(
    "natural_sort_groups",
    f"{_FAIR_SRC} SELECT attribute, grp, f1, CAST(row_number() OVER (PARTITION BY attribute ORDER BY "
    "TRY_CAST(grp AS DOUBLE) ASC NULLS LAST, grp) AS INTEGER) AS position FROM fairness WHERE level = 'group' AND dataset = 'train'",
)
def q_natural_sort_groups(spark, sf):
    from pyspark.sql import Window

    from cohortspark.operators import fairness as FA

    f = _fair(spark, sf).filter((F.col("level") == "group") & (F.col("dataset") == "train"))
    w = Window.partitionBy("attribute").orderBy(*FA.natural_order("grp"))
    return r6(f.select("attribute", "grp", "f1", F.row_number().over(w).alias("position")))


@register(
    "distinct_groups",
    f"{W} SELECT CAST(COUNT(DISTINCT gender) AS BIGINT) AS n_gender, CAST(COUNT(DISTINCT ethnicity) AS BIGINT) AS n_ethnicity, "
    "CAST(COUNT(DISTINCT age_group) AS BIGINT) AS n_age_group, CAST(COUNT(DISTINCT study_id) AS BIGINT) AS n_study_id FROM prepared",
)
def q_distinct_groups(spark, sf):
    from cohortspark.operators import fairness as FA

    return FA.distinct_groups(reports(spark, sf, False), ["gender", "ethnicity", "age_group", "study_id"])


@register(
    "sample_size_check",
    f"{_FAIR_SRC}, pg AS (SELECT attribute, grp, CAST(SUM(tp + fn) AS DOUBLE) / SUM(n) AS prevalence, CAST(SUM(n) AS BIGINT) AS n "
    "FROM fairness WHERE level = 'group' GROUP BY attribute, grp) "
    "SELECT attribute, grp, n, round(prevalence, 6) AS prevalence, "
    "round(CASE WHEN prevalence > 0 AND prevalence < 1 THEN 4 / (0.9 * (-ln(1 - 0.05))) / (prevalence * (1 - prevalence)) END, 6) AS needed_n "
    "FROM pg",
)
def q_sample_size_check(spark, sf):
    from cohortspark.operators import study as ST

    return r6(ST.sample_size_check(_patients(spark, sf), DEMO, "gold"))


# --------------------------------------------------------------------------- #
# Splits                                                                      #
# --------------------------------------------------------------------------- #
_DIG_SQL = "md5(COALESCE(text, 'nan')) AS doc_digest"


def _digested(spark, sf) -> DataFrame:
    return TV.report_view(spark, sf).withColumn("doc_digest", P.doc_digest("text"))


@register(
    "exclude_leaked_docs",
    f"{W}, dg AS (SELECT doc_id, split_leaky, {_DIG_SQL} FROM reports) SELECT v.doc_id, v.doc_digest FROM dg v "
    "WHERE v.split_leaky = 'validation' AND NOT EXISTS (SELECT 1 FROM dg t WHERE t.split_leaky = 'train' AND t.doc_digest = v.doc_digest)",
)
def q_exclude_leaked_docs(spark, sf):
    from cohortspark.operators import splits as SP

    d = _digested(spark, sf).select("doc_id", "split_leaky", "doc_digest")
    out = SP.exclude_leaked_docs(d.filter(F.col("split_leaky") == "train"), d.filter(F.col("split_leaky") == "validation"))
    return out.select("doc_id", "doc_digest")


@register(
    "split_overlap",
    f"{W}, dg AS (SELECT split, {_DIG_SQL} FROM reports) SELECT doc_digest FROM dg WHERE split = 'train' "
    "INTERSECT SELECT doc_digest FROM dg WHERE split = 'validation'",
)
def q_split_overlap(spark, sf):
    from cohortspark.operators import splits as SP

    d = _digested(spark, sf)
    return SP.split_overlap(d.filter(F.col("split") == "train"), d.filter(F.col("split") == "validation"), "doc_digest")


@register(
    "split_diagnostics",
    f"{W}, dg AS (SELECT study_id, split_leaky, {_DIG_SQL} FROM reports), "
    "si AS (SELECT study_id FROM dg WHERE split_leaky = 'train' INTERSECT SELECT study_id FROM dg WHERE split_leaky = 'validation'), "
    "sd AS (SELECT doc_digest FROM dg WHERE split_leaky = 'train' INTERSECT SELECT doc_digest FROM dg WHERE split_leaky = 'validation') "
    "SELECT 'shared_ids' AS \"check\", CAST(COUNT(*) AS BIGINT) AS n, MIN(CAST(study_id AS VARCHAR)) AS example FROM si "
    "UNION ALL SELECT 'shared_digests', CAST(COUNT(*) AS BIGINT), MIN(doc_digest) FROM sd "
    "UNION ALL SELECT 'label_as_text', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR)",
)
def q_split_diagnostics(spark, sf):
    from cohortspark.operators import splits as SP

    d = _digested(spark, sf)
    tr, va = d.filter(F.col("split_leaky") == "train"), d.filter(F.col("split_leaky") == "validation")
    return SP.split_diagnostics(tr, va, "study_id", "doc_digest", ["gold", "gold_alt"], ["text"])


@register(
    "union_splits",
    f"{W} SELECT doc_id, split AS dataset, gold, NULL::INTEGER AS gold_alt FROM reports WHERE split = 'train' "
    "UNION ALL SELECT doc_id, split, NULL::INTEGER, gold_alt FROM reports WHERE split = 'validation'",
)
def q_union_splits(spark, sf):
    from cohortspark.operators import splits as SP

    v = TV.report_view(spark, sf, False)
    tr = v.filter(F.col("split") == "train").select("doc_id", "gold")
    va = v.filter(F.col("split") == "validation").select("doc_id", "gold_alt")
    return SP.union_splits(tr, va, names=["train", "validation"]).select("doc_id", "dataset", "gold", "gold_alt")


@register(
    "missing_columns",
    "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
)
def q_missing_columns(spark, sf):
    from cohortspark.operators import splits as SP

    return SP.missing_keys(TV.table(spark, sf, "documents"), TV.table(spark, sf, "labels"), "doc_id")


# --------------------------------------------------------------------------- #
# Roll-ups                                                                    #
# --------------------------------------------------------------------------- #
@register(
    "patient_flag_per_report",
    f"{W}, {O.flagged_cte()} SELECT doc_id, report_col, pred, MAX(pred) OVER (PARTITION BY study_id, report_col) AS patient_flag FROM flagged",
)
def q_patient_flag_per_report(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark)).select("doc_id", "study_id", "report_col", "pred")
    return R.patient_flag_per_report(f, "pred").select("doc_id", "report_col", "pred", "patient_flag")


@register(
    "patient_final_flag",
    f"{W}, {O.flagged_cte()} SELECT doc_id, COALESCE(MAX(CASE WHEN GREATEST(pred_a, pred_b) >= 1 THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY study_id), 0) AS final_prediction FROM flagged",
)
def q_patient_final_flag(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark)).select("doc_id", "study_id", "pred_a", "pred_b")
    return R.patient_final_flag(f, ["pred_a", "pred_b"]).select("doc_id", "final_prediction")


@register(
    "final_flag",
    f"{W}, {O.flagged_cte()}, fw AS (SELECT study_id, visit_id, "
    + ", ".join(f"MAX(CASE WHEN report_col = {O.q(s)} THEN pred END) AS {s}" for s in TV.REPORT_SLOTS)
    + " FROM flagged GROUP BY study_id, visit_id) SELECT study_id, visit_id, COALESCE(CAST(GREATEST("
    + ", ".join(TV.REPORT_SLOTS) + ") >= 1 AS INTEGER), 0) AS final_prediction FROM fw",
)
def q_final_flag(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    wide = f.groupBy("study_id", "visit_id").pivot("report_col", TV.REPORT_SLOTS).agg(F.max("pred"))
    return wide.select("study_id", "visit_id", R.final_flag(*TV.REPORT_SLOTS).alias("final_prediction"))


@register(
    "attach_patient_score",
    f"{W}, {SCORED_SQL}, pt AS (SELECT DISTINCT study_id FROM reports WHERE split = 'validation'), "
    "sc AS (SELECT study_id, MAX(score) AS s FROM scored WHERE doc_id % 3 <> 0 GROUP BY study_id) "
    "SELECT pt.study_id, round(COALESCE(sc.s, 0.0), 6) AS score FROM pt LEFT JOIN sc ON pt.study_id = sc.study_id",
)
def q_attach_patient_score(spark, sf):
    s = _scored(spark, sf)
    pts = s.filter(F.col("split") == "validation").select("study_id").distinct()
    rows = s.filter(F.col("doc_id") % 3 != 0)
    return r6(R.attach_patient_score(pts, rows, "score"))


@register(
    "hard_prob",
    f"{W}, {SCORED_SQL}, {O.flagged_cte('scored')} SELECT doc_id, round(COALESCE(CASE WHEN doc_id % 3 <> 0 THEN score END, "
    "CAST(pred AS DOUBLE)), 6) AS prob FROM flagged",
)
def q_hard_prob(spark, sf):
    f = C.regex_flag_docs(_scored(spark, sf), FX.vocab_df(spark))
    sc = F.when(F.col("doc_id") % 3 != 0, F.col("score"))
    return r6(f.select("doc_id", P.hard_prob("pred", sc).alias("prob")))


@register(
    "patient_text",
    f"{W} SELECT study_id, string_agg(COALESCE(text, ''), ' ' ORDER BY ord) AS patient_text FROM reports GROUP BY study_id",
)
def q_patient_text(spark, sf):
    return R.patient_text(TV.report_view(spark, sf))


@register(
    "patient_text_labels",
    f"{W} SELECT study_id, string_agg(COALESCE(text, ''), ' ' ORDER BY ord) AS patient_text, "
    "(list(gold_alt ORDER BY ord))[1] AS gold_alt FROM reports GROUP BY study_id",
)
def q_patient_text_labels(spark, sf):
    return R.patient_text_labels(TV.report_view(spark, sf), "gold_alt")


@register(
    "first_per_key",
    "SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, arg_min(o_orderkey, o_orderkey) AS o_orderkey, "
    "arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, round(arg_min(o_totalprice, o_orderkey), 6) AS o_totalprice "
    "FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)",
)
def q_first_per_key(spark, sf):
    o = TV.table(spark, sf, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderkey", "o_orderstatus", "o_totalprice"
    )
    return r6(R.first_per_key(o.withColumn("ord", F.col("o_orderkey")), ["o_custkey", "o_orderdate"]).drop("ord"))


@register(
    "coverage",
    f"{W}, {O.flagged_cte()} SELECT split, report_col, CAST(COUNT(*) AS BIGINT) AS total, "
    "CAST(COUNT(*) FILTER (WHERE gold_alt IS NOT NULL AND pred IS NOT NULL) AS BIGINT) AS n, "
    "round(COUNT(*) FILTER (WHERE gold_alt IS NOT NULL AND pred IS NOT NULL) * 100.0 / COUNT(*), 6) AS coverage_pct "
    "FROM flagged GROUP BY split, report_col",
)
def q_coverage(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    return r6(M.coverage(f, DOC_KEYS, FX.LABEL, "pred"))


@register(
    "per_class_report",
    f"{W}, {O.flagged_cte()}, {O.evaluate_sql('(SELECT split, gold_alt AS gold, pred, prob FROM flagged)', ['split'])}, "
    "pc AS (SELECT split, '0' AS class, CASE WHEN tn+fn>0 THEN tn*1.0/(tn+fn) ELSE 0 END AS p, CASE WHEN tn+fp>0 THEN tn*1.0/(tn+fp) ELSE 0 END AS r, CAST(tn+fp AS DOUBLE) AS support FROM evaluation "
    "UNION ALL SELECT split, '1', CASE WHEN tp+fp>0 THEN tp*1.0/(tp+fp) ELSE 0 END, CASE WHEN tp+fn>0 THEN tp*1.0/(tp+fn) ELSE 0 END, CAST(tp+fn AS DOUBLE) FROM evaluation), "
    "pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0 END AS f FROM pc), "
    "tot AS (SELECT split, SUM(support) AS n FROM pf GROUP BY split) "
    "SELECT split, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM pf "
    "UNION ALL SELECT e.split, 'accuracy', NULL, NULL, round((tp+tn)*1.0/n, 6), CAST(n AS DOUBLE) FROM evaluation e "
    "UNION ALL SELECT pf.split, 'macro avg', round(AVG(p), 6), round(AVG(r), 6), round(AVG(f), 6), MAX(tot.n) FROM pf JOIN tot USING (split) GROUP BY pf.split "
    "UNION ALL SELECT pf.split, 'weighted avg', round(SUM(p*support)/MAX(tot.n), 6), round(SUM(r*support)/MAX(tot.n), 6), round(SUM(f*support)/MAX(tot.n), 6), MAX(tot.n) FROM pf JOIN tot USING (split) GROUP BY pf.split",
)
def q_per_class_report(spark, sf):
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    return r6(M.per_class_report(M.confusion(f, ["split"], FX.LABEL, "pred"), ["split"]))


# --------------------------------------------------------------------------- #
# Phrases and negation                                                        #
# --------------------------------------------------------------------------- #
PCATS = sorted({c for c, _ in FX.PHRASES})
_NEG_SQL = f"{W}, {O.negation_sql('reports', ['doc_id'], 'text', FX.PHRASES, FX.CUES)}"
_PF_SQL = (
    "pf AS (SELECT doc_id, "
    + ", ".join(f"MAX(CASE WHEN category = {O.q(c)} THEN 1 ELSE 0 END) AS pred_{c.lower()}" for c in PCATS)
    + ", MAX(CASE WHEN category IN (" + ", ".join(O.q(c) for c in PCATS) + ") THEN 1 ELSE 0 END) AS pred_any "
    "FROM negm WHERE NOT negated GROUP BY doc_id)"
)


def _docs_text(spark, sf) -> DataFrame:
    return TV.text_view(spark, sf)


@register(
    "phrase_match",
    f"{W} SELECT doc_id, CAST(seg AS INTEGER) AS seg, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", category, phrase FROM "
    f"{O.phrase_match_sql('reports', ['doc_id'], 'text', FX.PHRASES, 'category', False)}",
)
def q_phrase_match(spark, sf):
    from cohortspark.operators import match as MT

    m = MT.phrase_match(_docs_text(spark, sf), ["doc_id"], "text", FX.phrases_df(spark), "phrase", scoped=False)
    return m.select("doc_id", "seg", "start", "end", "category", "phrase")


@register(
    "negated_match",
    f"{_NEG_SQL} SELECT doc_id, CAST(seg AS INTEGER) AS seg, CAST(start AS INTEGER) AS start, "
    "CAST(\"end\" AS INTEGER) AS \"end\", category, phrase, negated FROM negm",
)
def q_negated_match(spark, sf):
    from cohortspark.operators import match as MT

    m = MT.negated_match(_docs_text(spark, sf), ["doc_id"], "text", FX.phrases_df(spark), FX.cues_df(spark), "phrase")
    return m.select("doc_id", "seg", "start", "end", "category", "phrase", "negated")


@register(
    "phrase_flags",
    f"{_NEG_SQL}, {_PF_SQL} SELECT r.doc_id, "
    + ", ".join(f"COALESCE(pf.pred_{c.lower()}, 0) AS pred_{c.lower()}" for c in PCATS)
    + ", COALESCE(pf.pred_any, 0) AS pred_any FROM reports r LEFT JOIN pf ON r.doc_id = pf.doc_id",
)
def q_phrase_flags(spark, sf):
    f = C.phrase_flag_docs(_docs_text(spark, sf), FX.phrases_df(spark), FX.cues_df(spark), PCATS)
    return f.select("doc_id", *[f"pred_{c.lower()}" for c in PCATS], "pred_any")


_PHRASE_FLAGGED = (
    "flagged AS (SELECT p.*, COALESCE(pf.pred_any, 0) AS pred, CAST(COALESCE(pf.pred_any, 0) AS DOUBLE) AS prob "
    "FROM prepared p LEFT JOIN pf ON p.doc_id = pf.doc_id)"
)


@register(
    "phrase_cohort",
    f"{_NEG_SQL}, {_PF_SQL}, {_PHRASE_FLAGGED}, {O.levels_cte(pred_type='Phrase')}, "
    f"{O.evaluate_sql('alllevels', C.LEVEL_COLS)} SELECT {', '.join(C.LEVEL_COLS)}, {O.EVAL_OUT} FROM evaluation",
)
def q_phrase_cohort(spark, sf):
    run = C.phrase_cohort(
        reports(spark, sf, False), FX.phrases_df(spark), FX.cues_df(spark), PCATS, FX.LABEL, texts=TV.text_view(spark, sf)
    )
    return r6(run["evaluation"])


# --------------------------------------------------------------------------- #
# Model answers                                                               #
# --------------------------------------------------------------------------- #
LIKELY_KEY, LIKELY_MIN = "k", 50.0
_DAMAGED = (
    "CASE WHEN event_id % 5 = 0 AND event_type = 'error' THEN '42' WHEN event_id % 5 = 0 THEN props "
    "WHEN event_id % 5 = 1 THEN regexp_replace(props, '\\}$', ',}') "
    "WHEN event_id % 5 = 2 THEN 'Answer: ' || props || ' (end)' "
    "WHEN event_id % 5 = 3 THEN regexp_replace(props, '\\}$', ' // checked' || chr(10) || '}') "
    "ELSE substring(props, 1, length(props) - 1) END"
)
_ANS_SQL = (
    f"ans AS (SELECT event_id AS ord, user_id AS study_id, CAST(ts AS DATE) AS procedure_date, {_DAMAGED} AS js FROM events), "
    "rep AS (SELECT *, json_valid(js) AND NOT regexp_matches(js, ',\\s*[}\\]]') AS direct_ok, "
    "regexp_replace(regexp_replace(regexp_replace(regexp_extract(js, '(?s)(\\{.*\\})', 1), '//[^\\n\\r]*', '', 'g'), "
    "',\\s*\\}', '}', 'g'), ',\\s*\\]', ']', 'g') AS fixed FROM ans), "
    "st AS (SELECT *, COALESCE(direct_ok AND ltrim(js) LIKE '{%', false) AS object_ok, CASE WHEN direct_ok THEN 'valid' "
    "WHEN fixed <> '' AND json_valid(fixed) AND ltrim(fixed) LIKE '{%' THEN 'repaired' ELSE 'none' END AS status FROM rep), "
    f"parsed AS (SELECT *, object_ok OR status = 'repaired' AS responded, CASE status WHEN 'valid' THEN TRY_CAST(json_extract_string(js, '$.{LIKELY_KEY}') AS DOUBLE) "
    f"WHEN 'repaired' THEN TRY_CAST(json_extract_string(fixed, '$.{LIKELY_KEY}') AS DOUBLE) END AS likelihood FROM st), "
    f"resp AS (SELECT *, COALESCE(CAST(likelihood >= {LIKELY_MIN} AS INTEGER), 0) AS pred FROM parsed)"
)


def _responses(spark, sf) -> DataFrame:
    from cohortspark.operators import responses as RS

    a = RS.repair_json(TV.answers(spark, sf), "json_response", "full_response")
    return RS.parse_response(a, {"likelihood": LIKELY_KEY}, LIKELY_MIN)


@register("repair_json", f"WITH {_ANS_SQL} SELECT ord AS event_id, status FROM resp")
def q_repair_json(spark, sf):
    return _responses(spark, sf).select(F.col("ord").alias("event_id"), "status")


@register("parse_response", f"WITH {_ANS_SQL} SELECT ord AS event_id, likelihood, pred FROM resp")
def q_parse_response(spark, sf):
    return _responses(spark, sf).select(F.col("ord").alias("event_id"), "likelihood", "pred")


@register(
    "llm_response_summary",
    f"WITH {_ANS_SQL}, sm AS (SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(DISTINCT study_id) AS BIGINT) AS patients, "
    "CAST(COUNT(*) FILTER (WHERE status = 'valid') AS BIGINT) AS valid, "
    "CAST(COUNT(*) - COUNT(*) FILTER (WHERE status = 'valid') - COUNT(*) FILTER (WHERE NOT responded) AS BIGINT) AS repaired, "
    "CAST(COUNT(*) FILTER (WHERE NOT responded) AS BIGINT) AS no_response, CAST(COUNT(*) FILTER (WHERE responded) AS BIGINT) AS successful, "
    "CAST(SUM(pred) AS BIGINT) AS predicted FROM resp) "
    "SELECT *, round(valid * 100.0 / total, 1) AS valid_pct, round(repaired * 100.0 / total, 1) AS repaired_pct, "
    "round(no_response * 100.0 / total, 1) AS no_response_pct, round(successful * 100.0 / total, 1) AS successful_pct, "
    "round(predicted * 100.0 / total, 1) AS predicted_pct FROM sm",
)
def q_llm_response_summary(spark, sf):
    from cohortspark.operators import responses as RS

    return RS.response_summary(_responses(spark, sf))


_HUMAN_SQL = (
    "hum AS (SELECT o_custkey % 150 AS study_id, CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS endoscopy_date, "
    "CAST(o_orderstatus = 'F' AS INTEGER) AS gold, o_orderkey AS ord FROM orders), "
    "hum1 AS (SELECT study_id, endoscopy_date, arg_min(gold, ord) AS gold, MIN(ord) AS ord_human FROM hum GROUP BY ALL), "
    "llm1 AS (SELECT study_id, procedure_date, arg_min(status, ord) AS status, arg_min(likelihood, ord) AS likelihood0, "
    "(list(likelihood ORDER BY ord))[1] AS likelihood, arg_min(pred, ord) AS pred0, MIN(ord) AS ord_llm FROM resp GROUP BY ALL), "
    "merged AS (SELECT h.study_id, h.endoscopy_date, l.procedure_date, h.gold, l.status, l.likelihood, "
    "CASE WHEN l.status <> 'none' THEN l.pred0 END AS pred, h.ord_human, l.ord_llm "
    "FROM hum1 h JOIN llm1 l ON h.study_id = l.study_id AND h.endoscopy_date = l.procedure_date)"
)


def _merged(spark, sf) -> DataFrame:
    from cohortspark.operators import responses as RS

    llm = _responses(spark, sf).select("study_id", "procedure_date", "status", "likelihood", "pred", "ord", "json_response")
    return RS.merge_with_human(
        llm, TV.human_labels(spark, sf), ["study_id", "procedure_date"], ["study_id", "endoscopy_date"], drop=["json_response"]
    )


@register(
    "merge_llm_human",
    f"WITH {_ANS_SQL}, {_HUMAN_SQL} SELECT study_id, endoscopy_date, procedure_date, gold, status, likelihood, pred, "
    "ord_human, ord_llm FROM merged",
)
def q_merge_llm_human(spark, sf):
    return _merged(spark, sf).select(
        "study_id", "endoscopy_date", "procedure_date", "gold", "status", "likelihood", "pred", "ord_human", "ord_llm"
    )


@register(
    "llm_cohort",
    f"WITH {_ANS_SQL}, {_HUMAN_SQL}, src AS (SELECT 'all' AS dataset, 'patient' AS level, 'final' AS report_col, "
    "'LLM' AS pred_type, gold, pred, CAST(pred AS DOUBLE) AS prob FROM merged), "
    f"{O.evaluate_sql('src', C.LEVEL_COLS)} SELECT {', '.join(C.LEVEL_COLS)}, {O.EVAL_OUT} FROM evaluation",
)
def q_llm_cohort(spark, sf):
    m = _merged(spark, sf).select(
        F.lit("all").alias("dataset"), F.lit("patient").alias("level"), F.lit("final").alias("report_col"),
        F.lit("LLM").alias("pred_type"), "gold", "pred", F.col("pred").cast("double").alias("prob"),
    )
    return r6(M.evaluate(m, C.LEVEL_COLS, "gold", "pred", "prob"))


@register(
    "llm_fairness",
    f"WITH {_ANS_SQL}, {_HUMAN_SQL}, cust AS (SELECT c.c_custkey AS study_id, c.c_mktsegment AS segment, r.r_name AS region "
    "FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey), "
    "mp AS (SELECT 'all' AS dataset, 'LLM' AS pred_type, m.pred, m.gold, COALESCE(c.segment, 'nan') AS segment, COALESCE(c.region, 'nan') AS region FROM merged m LEFT JOIN cust c ON m.study_id = c.study_id), "
    f"{O.fairness_sql('mp', FKEYS, ['segment', 'region'], [('segment', 'BUILDING'), ('region', 'EUROPE')])} "
    f"SELECT {FAIR_OUT} FROM fairness",
)
def q_llm_fairness(spark, sf):
    from cohortspark.operators import fairness as FA

    m = _merged(spark, sf).join(TV.patient_demographics(spark, sf), on="study_id", how="left")
    m = m.select(F.lit("all").alias("dataset"), F.lit("LLM").alias("pred_type"), "pred", "gold", "segment", "region")
    ref = spark.createDataFrame([("segment", "BUILDING"), ("region", "EUROPE")], "attribute string, ref_group string")
    rep = FA.fairness_report(m, FKEYS, ["segment", "region"], "pred", "gold", ref, null_as_group=True)  # a missing group is the group "nan"
    return r6(rep.select(*[c.strip() for c in FAIR_OUT.split(",")]))


# --------------------------------------------------------------------------- #
# Concepts                                                                    #
# --------------------------------------------------------------------------- #
_CR_SQL = (
    "cr AS (SELECT printf('C%07d', p_partkey % 500) AS CUI, CASE WHEN p_size > 45 THEN 'FRE' ELSE 'ENG' END AS LAT, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE 'P' END AS TS, CASE WHEN p_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS ISPREF, "
    "CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'PT' ELSE 'SY' END AS TTY, p_name AS STR, p_partkey AS ord FROM part)"
)


@register("load_concepts", f"WITH {_CR_SQL} SELECT CUI, LAT, TS, ISPREF, TTY, STR, ord FROM cr")
def q_load_concepts(spark, sf):
    return TV.concept_rows(spark, sf)


_TERMS_VALUES = ", ".join(f"({O.q(t)})" for t in FX.CONCEPT_TERMS)


@register(
    "term_to_concepts",
    f"WITH {_CR_SQL}, terms(term) AS (VALUES {_TERMS_VALUES}) SELECT t.term, "
    "COALESCE(string_agg(DISTINCT c.CUI, '|' ORDER BY c.CUI), '') AS cuis FROM terms t "
    "LEFT JOIN cr c ON lower(trim(c.STR)) = lower(trim(t.term)) GROUP BY t.term",
)
def q_term_to_concepts(spark, sf):
    from cohortspark.operators import concepts as CO

    terms = spark.createDataFrame([(t,) for t in FX.CONCEPT_TERMS], "term string")
    out = CO.term_to_concepts(TV.concept_rows(spark, sf), terms)
    return out.select("term", F.array_join("cuis", "|").alias("cuis"))


_CPAT = FX.CONCEPT_PATTERNS_A + FX.CONCEPT_PATTERNS_B
_CRX = "(?i)(?:" + "|".join(f"(?:{p})" for p in _CPAT) + ")"


@register(
    "relevant_concepts",
    f"WITH {_CR_SQL}, kept AS (SELECT * FROM cr WHERE LAT = 'ENG' AND TTY IN ('PT', 'SY')), "
    f"ids AS (SELECT DISTINCT CUI FROM kept WHERE regexp_matches(STR, {O.q(_CRX)})) "
    "SELECT CUI, TTY, STR, ord FROM kept WHERE CUI IN (SELECT CUI FROM ids)",
)
def q_relevant_concepts(spark, sf):
    from cohortspark.operators import concepts as CO

    rows, _ = CO.relevant_concepts(TV.concept_rows(spark, sf), _CPAT)
    return rows.select("CUI", "TTY", "STR", "ord")


@register(
    "relevant_concepts_counts",
    f"WITH {_CR_SQL} SELECT CAST(COUNT(*) AS BIGINT) AS rows_in, CAST(COUNT(*) FILTER (WHERE LAT <> 'ENG') AS BIGINT) AS dropped_language, "
    "CAST(COUNT(*) FILTER (WHERE LAT = 'ENG' AND TTY NOT IN ('PT', 'SY')) AS BIGINT) AS dropped_kind FROM cr",
)
def q_relevant_concepts_counts(spark, sf):
    from cohortspark.operators import concepts as CO

    _, counts = CO.relevant_concepts(TV.concept_rows(spark, sf), _CPAT)
    return counts


@register(
    "relevant_concepts_observed",
    f"WITH {_CR_SQL}, kept AS (SELECT * FROM cr WHERE LAT = 'ENG' AND TTY IN ('PT', 'SY')), "
    f"ids AS (SELECT DISTINCT CUI FROM kept WHERE regexp_matches(STR, {O.q(_CRX)})) "
    "SELECT n, count FROM (SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (WHERE LAT <> 'ENG') AS dropped_language, "
    "COUNT(*) FILTER (WHERE LAT = 'ENG' AND TTY NOT IN ('PT', 'SY')) AS dropped_kind, "
    "(SELECT COUNT(*) FROM kept WHERE CUI NOT IN (SELECT CUI FROM ids)) AS dropped_concept FROM cr) "
    "UNPIVOT (count FOR n IN (rows_in, dropped_language, dropped_kind, dropped_concept))",
)
def q_relevant_concepts_observed(spark, sf):
    from cohortspark.operators import concepts as CO

    _, counts = CO.relevant_concepts_observed(TV.concept_rows(spark, sf), _CPAT)
    return spark.createDataFrame(list(counts.items()), "n string, count bigint")


@register(
    "preferred_terms",
    f"WITH {_CR_SQL}, cp AS (SELECT CUI, arg_min(STR, ord) AS preferred FROM cr WHERE (TS = 'P' OR ISPREF = 'Y') "
    "AND TTY IN ('PT', 'PN', 'BN', 'IN') GROUP BY CUI), "
    "al AS (SELECT lower(STR) AS alias, arg_max(CUI, ord) AS CUI, MIN(ord) AS ord FROM cr GROUP BY lower(STR)) "
    "SELECT al.alias, COALESCE(cp.preferred, al.alias) AS preferred, al.CUI, al.ord FROM al LEFT JOIN cp ON al.CUI = cp.CUI",
)
def q_preferred_terms(spark, sf):
    from cohortspark.operators import concepts as CO

    _, term_pref = CO.preferred_terms(TV.concept_rows(spark, sf))
    return term_pref


@register("standardise_terms")
def q_standardise_terms(spark, sf):
    from cohortspark.operators import concepts as CO

    docs = TV.report_view(spark, sf).select("doc_id", "text")
    return CO.standardise_terms(docs, "doc_id", "text", FX.standard_terms_df(spark), out="standardised").select(
        "doc_id", "standardised"
    )


# --------------------------------------------------------------------------- #
# Features and explanations                                                   #
# --------------------------------------------------------------------------- #
_TOK2 = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]{2,}')"
_TOKANY = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]+')"
_TF_SQL = f"tf AS (SELECT doc_id, term, CAST(COUNT(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({_TOK2}) AS term FROM reports) GROUP BY ALL)"


def _tf(spark, sf, ngram_max=1, max_df=1.0) -> DataFrame:
    from cohortspark.operators import features as FE

    return FE.bow_features(TV.report_view(spark, sf).select("doc_id", "text"), "doc_id", "text", ngram_max, max_df)


@register("bow_features", f"{W}, {_TF_SQL} SELECT doc_id, term, tf FROM tf")
def q_bow_features(spark, sf):
    return _tf(spark, sf)


@register(
    "bow_features_bigram",
    f"{W}, tk AS (SELECT doc_id, {_TOK2} AS t FROM reports), "
    "gr AS (SELECT doc_id, unnest(t) AS term FROM tk UNION ALL "
    "SELECT doc_id, array_to_string(t[i:i + 1], ' ') FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tk)), "
    "tf0 AS (SELECT doc_id, term, CAST(COUNT(*) AS BIGINT) AS tf FROM gr GROUP BY ALL), "
    "dfq AS (SELECT term, COUNT(*) AS dfc FROM tf0 GROUP BY term) "
    "SELECT doc_id, term, tf FROM tf0 WHERE term IN (SELECT term FROM dfq WHERE dfc <= 0.75 * (SELECT COUNT(*) FROM reports))",
)
def q_bow_features_bigram(spark, sf):
    return _tf(spark, sf, 2, 0.75)


@register(
    "tfidf_features",
    f"{W}, {_TF_SQL}, nd AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM reports WHERE text IS NOT NULL), "
    "dfq AS (SELECT term, COUNT(*) AS dfc FROM tf GROUP BY term), "
    "w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1 + nd.n) / (1 + dfq.dfc)) + 1) AS w FROM tf JOIN dfq ON tf.term = dfq.term, nd), "
    "nr AS (SELECT doc_id, sqrt(SUM(w * w)) AS norm FROM w GROUP BY doc_id) "
    "SELECT w.doc_id, w.term, w.tf, round(w.w / nr.norm, 6) AS weight FROM w JOIN nr ON w.doc_id = nr.doc_id",
)
def q_tfidf_features(spark, sf):
    from cohortspark.operators import features as FE

    v = TV.report_view(spark, sf)
    n = v.filter(F.col("text").isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    return r6(FE.tfidf_features(_tf(spark, sf), "doc_id", n))


@register(
    "stratified_folds",
    f"{W} SELECT doc_id, gold_alt, CAST((row_number() OVER (PARTITION BY gold_alt ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold "
    "FROM reports WHERE gold_alt IS NOT NULL",
)
def q_stratified_folds(spark, sf):
    from cohortspark.operators import features as FE

    v = TV.report_view(spark, sf, False).filter(F.col("gold_alt").isNotNull()).select("doc_id", "gold_alt")
    return FE.stratified_folds(v, "doc_id", "gold_alt", 5).select("doc_id", "gold_alt", "fold")


_WV_SQL = (
    "wv AS (SELECT w.word, e.embedding AS vector FROM (SELECT DISTINCT unnest(" + _TOKANY + ") AS word FROM benchmark) w "
    "JOIN embeddings e ON e.vec_id = (ascii(w.word) * 7 + length(w.word) * 13) % 500)"
)


@register(
    "mean_word_vectors",
    f"{W}, {_WV_SQL}, tk AS (SELECT doc_id, {_TOKANY} AS t FROM reports), "
    "kn AS (SELECT k.doc_id, wv.vector FROM (SELECT doc_id, unnest(t) AS word FROM tk) k JOIN wv ON k.word = wv.word), "
    "sm AS (SELECT doc_id, d - 1 AS dim, SUM(CAST(vector[d] AS DOUBLE)) AS s FROM (SELECT doc_id, vector, unnest(range(1, 65)) AS d FROM kn) GROUP BY ALL), "
    "gd AS (SELECT doc_id, len(t) AS ntok, unnest(range(0, 64)) AS dim FROM tk) "
    "SELECT gd.doc_id, gd.dim, round(CASE WHEN ntok > 0 THEN COALESCE(sm.s, 0.0) / ntok ELSE 0.0 END, 6) AS value "
    "FROM gd LEFT JOIN sm ON gd.doc_id = sm.doc_id AND gd.dim = sm.dim",
)
def q_mean_word_vectors(spark, sf):
    from cohortspark.operators import features as FE

    docs = TV.report_view(spark, sf).select("doc_id", "text")
    out = FE.mean_word_vectors(docs, "doc_id", "text", TV.word_vectors(spark, sf), 64)
    return r6(out.select("doc_id", F.col("dim").cast("long").alias("dim"), "value"))


_EMB_SQL = (
    "el AS (SELECT vec_id, d - 1 AS dim, CAST(embedding[d] AS DOUBLE) AS value, CAST(label < 5 AS INTEGER) AS y "
    "FROM (SELECT vec_id, embedding, label, unnest(range(1, 65)) AS d FROM embeddings)), "
    "co AS (SELECT dim, corr(value, y) AS coefficient FROM el GROUP BY dim)"
)


def _emb_long(spark, sf) -> DataFrame:
    e = TV.table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"), "y"
    )


@register(
    "dimension_exemplars",
    f"WITH {_EMB_SQL}, tp AS (SELECT dim, coefficient FROM co ORDER BY abs(coefficient) DESC, dim LIMIT 3), "
    "rk AS (SELECT el.dim, tp.coefficient, el.vec_id, el.value, row_number() OVER (PARTITION BY el.dim ORDER BY el.value DESC, el.vec_id) AS hi, "
    "row_number() OVER (PARTITION BY el.dim ORDER BY el.value ASC, el.vec_id) AS lo FROM el JOIN tp ON el.dim = tp.dim) "
    "SELECT dim, round(coefficient, 6) AS coefficient, vec_id, round(value, 6) AS value, CASE WHEN hi <= 5 THEN 'top' ELSE 'bottom' END AS side, "
    "CASE WHEN hi <= 5 THEN hi ELSE lo END AS rank FROM rk WHERE hi <= 5 OR lo <= 5",
)
def q_dimension_exemplars(spark, sf):
    from cohortspark.operators import explain as EX

    el = _emb_long(spark, sf)
    coefs = el.groupBy("dim").agg(F.corr("value", F.col("y").cast("double")).alias("coefficient"))
    out = EX.dimension_exemplars(el.drop("y"), coefs, "vec_id", 3, 5)
    return r6(out.withColumn("rank", F.col("rank").cast("long")))


_LOGODDS_SQL = (
    "lab AS (SELECT doc_id, gold_alt AS y FROM reports WHERE gold_alt IS NOT NULL), "
    "cls AS (SELECT SUM(y) AS npos, COUNT(*) - SUM(y) AS nneg FROM lab), "
    "tl AS (SELECT tf.term, SUM(l.y) AS p, COUNT(*) - SUM(l.y) AS q FROM tf JOIN lab l ON tf.doc_id = l.doc_id GROUP BY tf.term), "
    "coefs AS (SELECT term AS feature, ln((p + 1.0) / (npos + 2.0)) - ln((q + 1.0) / (nneg + 2.0)) AS coefficient FROM tl, cls)"
)


def _log_odds(spark, sf, tf: DataFrame) -> DataFrame:
    from cohortspark.operators import classify as CL

    lab = TV.report_view(spark, sf, False).filter(F.col("gold_alt").isNotNull()).select("doc_id", F.col("gold_alt").alias("y"))
    return CL.log_count_ratio(tf, lab, "doc_id")


@register(
    "feature_importance",
    f"{W}, {_TF_SQL}, {_LOGODDS_SQL}, "
    "hd AS (SELECT feature, coefficient, 'positive' AS side, row_number() OVER (ORDER BY coefficient DESC, feature) AS rank FROM coefs), "
    "tl2 AS (SELECT feature, coefficient, 'negative' AS side, row_number() OVER (ORDER BY coefficient ASC, feature) AS rank FROM coefs) "
    "SELECT feature, round(coefficient, 6) AS coefficient, side, CAST(rank AS INTEGER) AS rank FROM hd WHERE rank <= 10 "
    "UNION ALL SELECT feature, round(coefficient, 6), side, CAST(rank AS INTEGER) FROM tl2 WHERE rank <= 10",
)
def q_feature_importance(spark, sf):
    from cohortspark.operators import explain as EX

    coefs = _log_odds(spark, sf, _tf(spark, sf))
    return r6(EX.feature_importance(coefs, 10))


@register(
    "linear_attribution",
    f"{W}, {_TF_SQL}, {_LOGODDS_SQL}, nd AS (SELECT CAST(COUNT(DISTINCT doc_id) AS DOUBLE) AS n FROM tf), "
    "st AS (SELECT term, SUM(tf) / MAX(nd.n) AS mean, COUNT(*) AS dfc FROM tf, nd GROUP BY term), "
    "ph AS (SELECT tf.term, SUM(abs(c.coefficient * (tf.tf - st.mean))) AS a FROM tf JOIN st ON tf.term = st.term "
    "JOIN coefs c ON c.feature = tf.term GROUP BY tf.term) "
    "SELECT st.term, round((COALESCE(ph.a, 0) + (nd.n - st.dfc) * abs(c.coefficient * st.mean)) / nd.n, 6) AS mean_abs_phi "
    "FROM st JOIN coefs c ON c.feature = st.term LEFT JOIN ph ON ph.term = st.term, nd",
)
def q_linear_attribution(spark, sf):
    from cohortspark.operators import explain as EX

    tf = _tf(spark, sf)
    _, rank = EX.linear_attribution(tf, _log_odds(spark, sf, tf), "doc_id")
    return r6(rank)


_PIECES_SQL = (
    "tks AS (SELECT doc_id AS doc, unnest(" + _TOKANY.replace("COALESCE(text, '')", "COALESCE(text, '')") + ") AS tok, "
    "unnest(range(0, len(" + _TOKANY + "))) AS tpos FROM documents), "
    "pcs AS (SELECT doc, tpos, tok, unnest(range(0, CAST(ceil(length(tok) / 4.0) AS BIGINT))) AS j FROM tks), "
    "ts AS (SELECT doc, tpos * 1000 + j AS pos, CASE WHEN j = 0 THEN substring(tok, j * 4 + 1, 4) ELSE '##' || substring(tok, j * 4 + 1, 4) END AS token, "
    "(ascii(substring(tok, j * 4 + 1, 4)) % 11 - 5) / 4.0 AS score FROM pcs), "
    "mw AS (SELECT doc, SUM(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS word_id, "
    "pos, CASE WHEN starts_with(token, '##') THEN substring(token, 3) ELSE token END AS piece, score FROM ts WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]', '<s>', '</s>', '<pad>')), "
    "words AS (SELECT doc, word_id, string_agg(piece, '' ORDER BY pos) AS word, SUM(score) AS score, MIN(pos) AS start_pos FROM mw GROUP BY doc, word_id)"
)


def _words(spark, sf) -> DataFrame:
    from cohortspark.operators import explain as EX

    return EX.merge_subwords(TV.token_scores(spark, sf), "doc", "pos")


@register(
    "merge_subwords",
    f"WITH {_PIECES_SQL} SELECT doc, CAST(word_id AS BIGINT) AS word_id, word, round(score, 6) AS score, "
    "CAST(start_pos AS INTEGER) AS start_pos FROM words",
)
def q_merge_subwords(spark, sf):
    return r6(_words(spark, sf).select("doc", F.col("word_id").cast("long").alias("word_id"), "word", "score", "start_pos"))


@register(
    "top_tokens",
    f"WITH {_PIECES_SQL}, fw AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY abs(score) DESC, start_pos) AS r FROM words "
    "WHERE length(word) >= 4) "
    "SELECT doc, string_agg(printf('%s(%+.2f)', word, score), ' | ' ORDER BY r) AS top_tokens FROM fw WHERE r <= 10 GROUP BY doc",
)
def q_top_tokens(spark, sf):
    from cohortspark.operators import explain as EX

    return EX.top_tokens(_words(spark, sf), "doc", 10)


# --------------------------------------------------------------------------- #
# Learned cohorts and model operators (rows-only checks)                      #
# --------------------------------------------------------------------------- #
def _digests(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", P.doc_digest(["text"]).alias("doc_digest"))


def _text_cohort(spark, sf, pred_type, **learn) -> dict:
    from cohortspark.plans import learned as L

    texts = TV.text_view(spark, sf)
    return L.text_cohort(
        reports(spark, sf, False), texts, _digests(texts), TV.REPORT_SLOTS, FX.LABEL, pred_type, demographics=DEMO,
        reference=FX.reference_df(spark), **learn,
    )


@register("bow_cohort")
def q_bow_cohort(spark, sf):
    return r6(_text_cohort(spark, sf, "BOW")["evaluation"])


@register("bow_cohort_fairness")
def q_bow_cohort_fairness(spark, sf):
    return r6(_text_cohort(spark, sf, "BOW")["fairness"])


@register("bow_cohort_search")
def q_bow_cohort_search(spark, sf):
    from cohortspark import defaults

    return r6(_text_cohort(spark, sf, "BOW", settings=[("l2", c) for c in defaults.GRID_C])["search"])


@register("tfidf_cohort")
def q_tfidf_cohort(spark, sf):
    return r6(_text_cohort(spark, sf, "TFIDF", tfidf=True, ngram_max=2, max_df=0.75)["evaluation"])


@register("tfidf_cohort_calibration")
def q_tfidf_cohort_calibration(spark, sf):
    return r6(_text_cohort(spark, sf, "TFIDF", tfidf=True, max_df=0.75)["calibration"])


@register("embedding_cohort")
def q_embedding_cohort(spark, sf):
    from cohortspark.plans import learned as L

    texts = TV.text_view(spark, sf)
    run = L.embedding_cohort(
        reports(spark, sf, False), texts, _digests(texts), TV.word_vectors(spark, sf), TV.REPORT_SLOTS, FX.LABEL,
        demographics=DEMO, reference=FX.reference_df(spark),
    )
    return r6(run["evaluation"])


@register(
    "patient_folds",
    f"{W}, pt AS (SELECT study_id, COALESCE(MAX(gold_alt), 0) AS g FROM reports WHERE split = 'train' GROUP BY study_id) "
    "SELECT study_id, CAST((row_number() OVER (PARTITION BY g ORDER BY study_id) - 1) % 5 AS INTEGER) AS fold FROM pt",
)
def q_patient_folds(spark, sf):
    from cohortspark.plans import learned as L

    return L.patient_folds(reports(spark, sf, False), FX.LABEL, 5)


@register(
    "term_index",
    f"{W}, {_TF_SQL} SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS feature, CAST(COUNT(*) AS BIGINT) AS df FROM tf GROUP BY term",
)
def q_term_index(spark, sf):
    from cohortspark.operators import features as FE
    from cohortspark.operators import terms as TE

    index, _ = TE.term_index(FE.bow_features(TV.text_view(spark, sf), "doc_id", "text"), "doc_id")
    return index.select("term", "feature", "df")


@register(
    "table_cohort",
    f"{W}, {_TF_SQL}, {_LOGODDS_SQL}, ms AS (SELECT doc_id, SUM(tf * coefficient) AS m FROM tf JOIN coefs ON coefs.feature = tf.term GROUP BY doc_id), "
    "scored AS (SELECT p.*, 1.0 / (1.0 + exp(-COALESCE(ms.m, 0.0))) AS prob FROM prepared p LEFT JOIN ms ON ms.doc_id = p.doc_id), "
    "flagged AS (SELECT *, CAST(prob >= 0.5 AS INTEGER) AS pred FROM scored), "
    f"{O.levels_cte(pred_type='Table')}, {O.evaluate_sql('alllevels', C.LEVEL_COLS)} SELECT {', '.join(C.LEVEL_COLS)}, {O.EVAL_OUT} FROM evaluation",
)
def q_table_cohort(spark, sf):
    from cohortspark.operators import features as FE
    from cohortspark.plans import learned as L

    tf = FE.bow_features(TV.text_view(spark, sf), "doc_id", "text")
    coefs = _log_odds(spark, sf, tf).select(F.col("feature").alias("term"), "coefficient")
    return r6(L.table_cohort(reports(spark, sf, False), tf, coefs, FX.LABEL)["evaluation"])


@register("stored_model_cohort", SQL["table_cohort"].replace("'Table'", "'Stored'"))
def q_stored_model_cohort(spark, sf):
    """The table cohort through the model store: coefficients saved as a version, loaded again, then scored."""
    from cohortspark.operators import features as FE
    from cohortspark.plans import learned as L
    from cohortspark.session import new_folder
    from cohortspark.sources import models as ST

    tf = FE.bow_features(TV.text_view(spark, sf), "doc_id", "text")
    path = new_folder(spark, "model")
    ST.save_model(path, {"weights": _log_odds(spark, sf, tf).select(F.col("feature").alias("term"), "coefficient")})
    weights = ST.load_model(spark, path, needs={"weights": ["term", "coefficient"]})["weights"]
    return r6(L.table_cohort(reports(spark, sf, False), tf, weights, FX.LABEL, "Stored")["evaluation"])


@register("train_text_classifier")
def q_train_text_classifier(spark, sf):
    from cohortspark.plans import learned as L

    scores, _ = L.text_model(reports(spark, sf, False), TV.text_view(spark, sf), FX.LABEL)
    return scores.filter("split = 'validation'").select("doc_id", "prob", "pred")


@register("predict_text")
def q_predict_text(spark, sf):
    from cohortspark.plans import learned as L

    scores, _ = L.text_model(reports(spark, sf, False), TV.text_view(spark, sf), FX.LABEL, ngram_max=2, tfidf=True)
    return scores.select("doc_id", "split", "prob", "pred")


@register("grid_search")
def q_grid_search(spark, sf):
    from cohortspark import defaults
    from cohortspark.operators import classify as CL
    from cohortspark.operators import features as FE

    lab = reports(spark, sf).filter((F.col("split") == "train") & F.col(FX.LABEL).isNotNull())
    folds = FE.stratified_folds(lab, "doc_id", FX.LABEL, defaults.CV_FOLDS)
    grid = CL.grid_search(
        folds, "text", FX.LABEL, "fold", defaults.GRID_MAX_DF, defaults.GRID_NGRAMS, defaults.GRID_PENALTY, defaults.GRID_C,
        num_folds=defaults.CV_FOLDS,
    )
    return r6(grid)


@register("embedding_classifier")
def q_embedding_classifier(spark, sf):
    from cohortspark.operators import classify as CL

    e = TV.table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    e = e.withColumn("split", F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train"))
    model = CL.embedding_classifier(e.filter(F.col("split") == "train"), "embedding", "y")
    p = CL.predict_embedding(model, e, "embedding")
    return r6(M.evaluate(p, ["split"], "y", "pred", "prob"))


@register("patient_meta_model")
def q_patient_meta_model(spark, sf):
    from cohortspark.operators import classify as CL

    docs = _text_cohort(spark, sf, "BOW")["documents"]
    feats = docs.groupBy("dataset", "study_id").pivot("report_col", TV.REPORT_SLOTS).agg(F.max("prob"))
    gold = docs.groupBy("dataset", "study_id").agg(F.coalesce(F.max("gold"), F.lit(0)).alias("gold"))
    pts = feats.join(gold, on=["dataset", "study_id"])
    out = CL.patient_meta_model(pts.filter(F.col("dataset") == "train"), pts.filter(F.col("dataset") == "validation"), TV.REPORT_SLOTS, "gold")
    return r6(out.select("study_id", "gold", "meta_prob", "meta_pred"))


@register(
    "scored_cohort",
    f"{W}, {SCORED_SQL}, flagged AS (SELECT *, CAST(score >= 0.4 AS INTEGER) AS pred, score AS prob FROM scored), "
    f"{O.levels_cte(pred_type='Scored')}, {O.evaluate_sql('alllevels', C.LEVEL_COLS)} "
    f"SELECT {', '.join(C.LEVEL_COLS)}, {O.EVAL_OUT} FROM evaluation",
)
def q_scored_cohort(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("score") >= 0.4).cast("int"))
    return r6(C.scored_cohort(s, FX.LABEL, pred_type="Scored")["evaluation"])


def _length_scorer():
    """A user's scorer for the query: a logistic curve of the text's length."""
    import numpy as np

    return lambda texts: 1.0 / (1.0 + np.exp((1500.0 - np.array([len(t) for t in texts], float)) / 500.0))


@register(
    "user_scored_cohort",
    f"{W}, scored AS (SELECT *, 1.0 / (1.0 + exp((1500.0 - length(coalesce(text, ''))) / 500.0)) AS score FROM prepared), "
    "flagged AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred, score AS prob FROM scored), "
    f"{O.levels_cte(pred_type='User')}, {O.evaluate_sql('alllevels', C.LEVEL_COLS)} "
    f"SELECT {', '.join(C.LEVEL_COLS)}, {O.EVAL_OUT} FROM evaluation",
)
def q_user_scored_cohort(spark, sf):
    from cohortspark.operators.scoring import score_with

    scores = score_with(TV.text_view(spark, sf), _length_scorer, ["text"]).select("doc_id", "score")
    return r6(C.scored_cohort(C.attach(reports(spark, sf, False), scores), FX.LABEL, pred_type="User")["evaluation"])


@register("compare_variants")
def q_compare_variants(spark, sf):
    from cohortspark.operators import concepts as CO

    rep = reports(spark, sf)
    std = CO.standardise_terms(rep, "doc_id", "text", FX.standard_terms_df(spark)).persist()
    # the standardised text spells the category words differently, so the same vocabulary finds less
    raw = C.regex_cohort(rep, FX.vocab_df(spark), FX.LABEL)["evaluation"]
    stdz = C.regex_cohort(std, FX.vocab_df(spark), FX.LABEL)["evaluation"]
    return r6(C.compare_variants({"raw": raw, "standardised": stdz}))


# --------------------------------------------------------------------------- #
# Sinks, formats, remaining projections                                       #
# --------------------------------------------------------------------------- #
_COHORT_EVAL_SQL = f"{W}, {O.flagged_cte()}, {O.levels_cte()}, {O.evaluate_sql('alllevels', C.LEVEL_COLS)}"


@register(
    "calibration_summary",
    f"{_COHORT_EVAL_SQL} SELECT report_col, pred_type, level, brier AS Brier_Score FROM evaluation WHERE dataset = 'validation'",
)
def q_calibration_summary(spark, sf):
    from cohortspark.sources import sinks as SK

    return SK.calibration_summary(q_regex_cohort(spark, sf))


@register("write_eval", f"{_COHORT_EVAL_SQL} SELECT {', '.join(C.LEVEL_COLS)}, n, tp, fp, fn, tn FROM evaluation")
def q_write_eval(spark, sf):
    from cohortspark.session import new_folder
    from cohortspark.sources import sinks as SK

    path = new_folder(spark, "eval_regex_cohort")
    SK.write_eval(q_regex_cohort(spark, sf), path)
    return spark.read.parquet(path).select(*C.LEVEL_COLS, "n", "tp", "fp", "fn", "tn")


@register("write_fairness", f"{_FAIR_SRC} SELECT dataset, level, attribute, grp, n, tp FROM fairness")
def q_write_fairness(spark, sf):
    from cohortspark.session import new_folder
    from cohortspark.sources import sinks as SK

    path = new_folder(spark, "fairness_regex_cohort")
    SK.write_fairness(q_fairness_report(spark, sf), path, fmt="csv")
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select(
        "dataset", "level", "attribute", "grp", F.col("n").cast("long").alias("n"), F.col("tp").cast("long").alias("tp")
    )


def _pct_sql(e, lo, hi):
    return (f"CASE WHEN {e} IS NULL THEN 'N/A' WHEN {lo} IS NULL OR {hi} IS NULL THEN printf('%.2f%% (CI: N/A)', {e} * 100) "
            f"ELSE printf('%.2f%% (CI: %.2f%% - %.2f%%)', {e} * 100, {lo} * 100, {hi} * 100) END")


@register(
    "format_metrics",
    f"{W}, {O.flagged_cte()}, {O.evaluate_sql('(SELECT split, report_col, gold_alt AS gold, pred, prob FROM flagged)', DOC_KEYS)}, "
    "fm AS (SELECT split, report_col, "
    + ", ".join(f"{_pct_sql(m, m + '_lo', m + '_hi')} AS {m}_text" for m in ["accuracy", "precision", "recall", "specificity", "npv"])
    + ", CASE WHEN mcc IS NULL THEN 'N/A' ELSE printf('%.4f', mcc) END AS mcc_text FROM evaluation) "
    "SELECT *, TRY_CAST(regexp_extract(accuracy_text, '^\\s*(-?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS accuracy_pct FROM fm",
)
def q_format_metrics(spark, sf):
    from cohortspark.functions import fmt as FM

    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    e = M.evaluate(f, DOC_KEYS, FX.LABEL, "pred", "prob")
    cols = [FM.pct_ci(m, f"{m}_lo", f"{m}_hi").alias(f"{m}_text") for m in ["accuracy", "precision", "recall", "specificity", "npv"]]
    out = e.select(*DOC_KEYS, *cols, FM.num("mcc").alias("mcc_text"))
    return out.withColumn("accuracy_pct", FM.leading_number("accuracy_text"))


@register(
    "combine_categories",
    f"{W}, {O.flagged_cte()} SELECT doc_id, pred_a, pred_b, GREATEST(pred_a, pred_b) AS combined FROM flagged",
)
def q_combine_categories(spark, sf):
    from cohortspark.operators import match as MT

    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    return f.select("doc_id", "pred_a", "pred_b", MT.combine_categories("pred_a", "pred_b").alias("combined"))


@register(
    "pattern_with_concept",
    f"{W} SELECT doc_id, "
    + O.regex_flag_sql("text", [p + r"(?:\s*\(C\d{4,}\))?" for c, p in FX.VOCAB if c == "A"]) + " AS pred_a, "
    "CAST(COALESCE(regexp_matches(text, '\\(C\\d{4,}\\)'), false) AS INTEGER) AS pred_cui FROM reports",
)
def q_pattern_with_concept(spark, sf):
    from cohortspark.operators import match as MT

    v = TV.report_view(spark, sf).select("doc_id", "text")
    voc = MT.pattern_with_concept(FX.vocab_df(spark).filter(F.col("category") == "A"))
    out = MT.regex_flags(v, voc, "text", whole_word=True)
    return out.select("doc_id", "pred_a", MT.regex_flag("text", [MT.CONCEPT_ID_PATTERN]).alias("pred_cui"))


@register("normalise_text")
def q_normalise_text(spark, sf):
    from cohortspark.operators import match as MT

    v = TV.report_view(spark, sf).select("doc_id", "text")
    return v.select("doc_id", MT.normalise_text("text").alias("text"))


@register("read_batches", "SELECT event_id, 'events.parquet' AS batch_file FROM events")
def q_read_batches(spark, sf):
    from cohortspark.sources import readers as RD

    return RD.read_batches(spark, f"{sf}/events.parquet", fmt="parquet").select("event_id", "batch_file")


@register(
    "drop_columns",
    f"{W} SELECT doc_id, study_id, visit_id, report_col, ord, gold, gold_alt, gender, ethnicity_raw, age, imd, split FROM reports",
)
def q_drop_columns(spark, sf):
    return P.drop_columns(TV.report_view(spark, sf), ["text", "split_leaky", "not_there"])


@register("alias_columns", f"{W}, {_WIDE_SQL} SELECT study_id, visit_id, pathology AS pathology_report, endoscopy AS endoscopy_report FROM wide")
def q_alias_columns(spark, sf):
    w = _wide(spark, sf)
    w = w.toDF(*[f"{c}_report_v2" if c in TV.REPORT_SLOTS else c for c in w.columns])
    out = P.alias_columns(w, ["pathology_report", "endoscopy_report"])
    return out.select("study_id", "visit_id", "pathology_report", "endoscopy_report")


@register("default_demographics", f"{W} SELECT doc_id, gender, CAST(NULL AS VARCHAR) AS cohort FROM reports")
def q_default_demographics(spark, sf):
    v = TV.report_view(spark, sf, False).select("doc_id", "gender")
    return P.default_demographics(v, ["gender", "cohort"])


# --------------------------------------------------------------------------- #
# Document-to-patient study                                                   #
# --------------------------------------------------------------------------- #
def _flag_patterns(spark, sf) -> DataFrame:
    """Visit rows: regex flag per report slot (features) and the patient label (target)."""
    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    wide = f.groupBy("study_id", "visit_id").pivot("report_col", TV.REPORT_SLOTS).agg(F.max("pred"))
    gold = f.groupBy("study_id").agg(F.coalesce(F.max(FX.LABEL), F.lit(0)).alias("patient"))
    return wide.join(gold, on="study_id")


_FP_SQL = (
    f"{W}, {O.flagged_cte()}, fw AS (SELECT study_id, visit_id, "
    + ", ".join(f"MAX(CASE WHEN report_col = {O.q(s)} THEN pred END) AS {s}" for s in TV.REPORT_SLOTS)
    + " FROM flagged GROUP BY study_id, visit_id), pg AS (SELECT study_id, COALESCE(MAX(gold_alt), 0) AS patient FROM flagged GROUP BY study_id), "
    "fp AS (SELECT fw.*, pg.patient FROM fw JOIN pg ON fw.study_id = pg.study_id)"
)
_CORR_COLS = [*TV.REPORT_SLOTS, "patient"]


@register(
    "label_correlation",
    _FP_SQL + " " + " UNION ALL ".join(
        f"SELECT {O.q(a)} AS a, {O.q(b)} AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM fp"
        for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i:]
    ),
)
def q_label_correlation(spark, sf):
    from cohortspark.operators import study as ST

    return r6(ST.label_correlation(_flag_patterns(spark, sf), _CORR_COLS))


@register("vif")
def q_vif(spark, sf):
    from cohortspark.operators import study as ST

    return r6(ST.vif(_flag_patterns(spark, sf), TV.REPORT_SLOTS))


@register("odds_ratios")
def q_odds_ratios(spark, sf):
    from cohortspark.operators import study as ST

    return r6(ST.odds_ratios(_flag_patterns(spark, sf), TV.REPORT_SLOTS, "patient"))


@register("label_tree")
def q_label_tree(spark, sf):
    from cohortspark.operators import study as ST

    return r6(ST.label_tree(_flag_patterns(spark, sf), TV.REPORT_SLOTS, "patient"))


@register("doc_to_patient_study")
def q_doc_to_patient_study(spark, sf):
    """Union of splits -> complete rows -> correlations, VIF, odds ratios, tree, the tree's per-class report (op 100).

    Of the regex flags of visits; sections that begin with ``labels_`` are the same study of the visits' report labels."""
    from cohortspark.operators import splits as SP
    from cohortspark.operators import study as ST
    from cohortspark.session import saved_table

    # Rows of flags and labels alone; all studies read them, the texts are read once.
    flagged = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    docs = saved_table(flagged.select("split", "study_id", "visit_id", "report_col", "pred", F.col(FX.LABEL).alias("label")), "flags")
    docs = SP.union_splits(docs.filter("split = 'train'"), docs.filter("split = 'validation'"), names=["train", "validation"])
    parts = []
    for kind, value in (("labels_", "label"), ("", "pred")):
        visits = saved_table(P.drop_incomplete(_visit_patterns(docs, value), [*TV.REPORT_SLOTS, "patient"]), "visits")
        parts += _study_sections(ST, visits, kind)
    or_pred = visits.withColumn("pred", R.final_flag(*TV.REPORT_SLOTS)).withColumn("k", F.lit("all"))
    parts.append(_per_class(M.confusion(or_pred, ["k"], "patient", "pred").drop("k"), "or_per_class_f1"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return r6(out)


def _visit_patterns(docs: DataFrame, value: str) -> DataFrame:
    """Visit rows: ``value`` per report slot and the patient label."""
    wide = docs.groupBy("study_id", "visit_id").pivot("report_col", TV.REPORT_SLOTS).agg(F.max(value))
    gold = docs.groupBy("study_id").agg(F.coalesce(F.max("label"), F.lit(0)).alias("patient"))
    return wide.join(gold, on="study_id")


def _per_class(counts: DataFrame, section: str) -> DataFrame:
    report = M.per_class_report(counts.withColumn("k", F.lit("all")), ["k"])
    return report.select(F.lit(section).alias("section"), F.col("class").alias("name"), F.col("f1").alias("value"))


def _study_sections(ST, visits: DataFrame, kind: str) -> list[DataFrame]:
    """(section, name, value) of every study of complete visit rows; the per-class report is that of the tree's own predictions."""
    tree, counts = ST.fit_label_tree(visits, TV.REPORT_SLOTS, "patient")
    return [
        ST.label_correlation(visits, _CORR_COLS).select(F.lit(f"{kind}correlation").alias("section"), F.concat_ws("~", "a", "b").alias("name"), F.col("corr").alias("value")),
        ST.vif(visits, TV.REPORT_SLOTS).select(F.lit(f"{kind}vif").alias("section"), F.col("feature").alias("name"), F.col("vif").alias("value")),
        ST.odds_ratios(visits, TV.REPORT_SLOTS, "patient").select(F.concat(F.lit(f"{kind}odds_"), "penalty").alias("section"), F.col("feature").alias("name"), F.col("odds_ratio").alias("value")),
        tree.select(F.concat(F.lit(f"{kind}tree_"), "kind").alias("section"), F.coalesce("feature", F.lit("")).alias("name"), "value"),
        _per_class(counts, f"{kind}per_class_f1"),
    ]


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf):
    """F1 and MCC intervals (exact binomial replicates) and PR-AUC intervals (Poisson replicates)."""
    from cohortspark.operators import bootstrap as BS

    f = C.regex_flag_docs(reports(spark, sf), FX.vocab_df(spark))
    counts = M.confusion(f, DOC_KEYS, FX.LABEL, "pred")
    counts_ci = BS.bootstrap_ci(counts, DOC_KEYS, ("f1", "mcc"), 1000, seed=0)
    s = _scored(spark, sf)
    ap = BS.bootstrap_pr_auc(s, DOC_KEYS, FX.LABEL, "score", 1000, seed=0).withColumn("metric", F.lit("pr_auc"))
    return r6(counts_ci.unionByName(ap.select(*DOC_KEYS, "metric", "estimate", "lo", "hi")))


def _pct_na(e, lo=None, hi=None):
    if lo is None:
        return f"CASE WHEN {e} IS NULL THEN 'N/A' ELSE printf('%.2f%% (CI: N/A)', {e} * 100) END"
    return _pct_sql(e, lo, hi)


@register(
    "evaluate_model",
    f"{W}, {SCORED_SQL}, {O.evaluate_sql('(SELECT split, report_col, gold_alt AS gold, CAST(score >= 0.4 AS INTEGER) AS pred, score AS prob FROM scored)', DOC_KEYS)}, "
    "tot AS (SELECT split, report_col, COUNT(*) AS total FROM reports GROUP BY ALL) "
    f"SELECT e.split AS Dataset, e.report_col AS Report_Column, {O.q(FX.LABEL)} AS Gold_Standard_Column, 'Scored' AS Prediction_Type, "
    "'' AS Demographic_Attribute, '' AS \"Group\", "
    + ", ".join(f"{_pct_sql(m, m + '_lo', m + '_hi')} AS {name}" for m, name in
                [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("specificity", "Specificity"), ("npv", "NPV")])
    + f", {_pct_na('f1')} AS F1_Score, CASE WHEN mcc IS NULL THEN 'N/A' ELSE printf('%.4f (CI: N/A)', mcc) END AS MCC, "
    f"{_pct_na('pr_auc')} AS PR_AUC, CASE WHEN brier IS NULL THEN 'N/A' ELSE printf('%.4f', brier) END AS Brier_Score, "
    "CASE WHEN ece IS NULL THEN 'N/A' ELSE printf('%.4f', ece) END AS ECE, n AS Coverage_Count, "
    "printf('%.2f%%', n * 100.0 / t.total) AS Coverage_Pct FROM evaluation e JOIN tot t ON e.split = t.split AND e.report_col = t.report_col",
)
def q_evaluate_model(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("score") >= 0.4).cast("int"))
    return M.evaluate_model(s, DOC_KEYS, FX.LABEL, "pred", "score", total_col="rows", dataset="split", report_col="report_col", pred_type="Scored")


@register("evaluate_model_intervals")
def q_evaluate_model_intervals(spark, sf):
    s = _scored(spark, sf).withColumn("pred", (F.col("score") >= 0.4).cast("int"))
    return M.evaluate_model(
        s, DOC_KEYS, FX.LABEL, "pred", "score", total_col="rows", bootstrap=True, dataset="split", report_col="report_col", pred_type="Scored"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
