"""End-to-end cohort compositions (ops 93-101).

Every family has the same shape: flag each report -> OR across a visit's
reports -> OR across a patient's visits -> metrics at each level -> fairness.
In long form each level is one table ``(dataset, level, report_col, study_id,
gold, pred, prob, demographics)``; the three levels are unioned and evaluated
by ONE histogram aggregation, so the whole cohort is one lazy plan with two
shuffles on the data (visit roll-up, patient roll-up) plus tiny metric tables.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import fairness as FA
from cohortspark.operators import match as MT
from cohortspark.operators import metrics as M
from cohortspark.operators import prep as P
from cohortspark.operators import rollup as R

LEVEL_COLS = ["dataset", "level", "report_col", "pred_type"]


def _doc_level(flagged: DataFrame, label: str, pred_type: str, demographics: list[str]) -> DataFrame:
    """Narrow document-level table (no text).  It feeds three consumers (document
    metrics, visit and patient roll-ups), so it is persisted: the expensive text
    work (regex, phrase joins, model scoring) then runs once per document.  The
    table holds ids, flags and scores only, a small fraction of the input bytes;
    a lost executor recomputes its blocks from the short lineage."""
    return flagged.select(
        F.col("split").alias("dataset"), "study_id", "visit_id", "report_col", "ord",
        F.col(label).alias("gold"), F.col("pred").cast("int").alias("pred"),
        F.col("prob").cast("double").alias("prob"), *demographics,
    ).withColumns({"level": F.lit("document"), "pred_type": F.lit(pred_type)}).persist(StorageLevel.MEMORY_AND_DISK)


def roll_up_levels(docs: DataFrame, pred_type: str, demographics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Document rows -> (visit rows, patient rows) with OR semantics and null -> 0.

    Visits: max over the visit's reports (``cumulative_or``); gold = any label.
    Patients: max over visits (``collapse_patients``); demographics = first
    non-null by row order.
    """
    visit = R.cumulative_or(docs, ["dataset", "study_id", "visit_id"], preds=["pred"], probs=["prob"], golds=["gold"])
    visit = visit.withColumns(
        {"level": F.lit("visit"), "report_col": F.lit("cumulative"), "pred_type": F.lit(pred_type)}
    )
    pat = R.collapse_patients(docs, ["pred", "prob", "gold"], demographics, id_col=["dataset", "study_id"])
    pat = pat.withColumns(
        {"level": F.lit("patient"), "report_col": F.lit("final"), "pred_type": F.lit(pred_type)}
    )
    return visit, pat


def evaluate_levels(docs: DataFrame, visit: DataFrame, pat: DataFrame) -> DataFrame:
    cols = [*LEVEL_COLS, "gold", "pred", "prob"]
    allr = docs.select(*cols).unionByName(visit.select(*cols)).unionByName(pat.select(*cols))
    return M.evaluate(allr, LEVEL_COLS, "gold", "pred", "prob")


def regex_flag_docs(reports: DataFrame, vocab: DataFrame, whole_word: bool = True) -> DataFrame:
    """Flag every report by every category, OR the categories (op 21), hard score (op 18)."""
    pats = MT.category_patterns(vocab)
    cats = sorted(pats)
    flagged = reports.withColumns({f"pred_{c.lower()}": MT.regex_flag("text", pats[c], whole_word) for c in cats})
    flagged = flagged.withColumn("pred", MT.combine_categories(*[f"pred_{c.lower()}" for c in cats]))
    return flagged.withColumn("prob", P.hard_prob("pred"))


def attach(reports: DataFrame, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Join narrow per-document results (flags, scores) to the narrow report rows.

    Text work runs on a (doc_id, text) frame; only its narrow output meets the
    label / demographic rows, so the text column never crosses this shuffle.
    """
    extra = [c for c in scored.columns if c == id_col or c not in reports.columns]
    return reports.drop("text").join(scored.select(*extra), on=id_col, how="inner")


def regex_cohort(
    reports: DataFrame, vocab: DataFrame, label: str = "gold_alt", demographics: list[str] = (),
    whole_word: bool = True, pred_type: str = "Combined_Regex", texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Regex family (op 93): evaluation rows for document, visit and patient levels, plus patient rows.

    ``texts`` (doc_id, text) is the text side; by default the reports' own text.
    """
    demographics = list(demographics)
    if texts is None:
        flagged = regex_flag_docs(reports, vocab, whole_word)
    else:
        flagged = attach(reports, regex_flag_docs(texts, vocab, whole_word).drop("text"))
    docs = _doc_level(flagged, label, pred_type, demographics)
    visit, pat = roll_up_levels(docs, pred_type, demographics)
    return {"docs": docs, "visits": visit, "patients": pat, "evaluation": evaluate_levels(docs, visit, pat)}


def phrase_flag_docs(
    reports: DataFrame, phrases: DataFrame, cues: DataFrame | None, categories: list[str], scope: str = "match",
) -> DataFrame:
    """Non-negated phrase matches -> per-document category flags; ``pred`` = any category (ops 65-67)."""
    base = reports.select("doc_id", "text")
    if cues is None:
        m = MT.phrase_match(base, ["doc_id"], "text", phrases, "phrase", scoped=True).withColumn("negated", F.lit(False))
    else:
        m = MT.negated_match(base, ["doc_id"], "text", phrases, cues, "phrase", scope)
    flags = MT.phrase_flags(reports.drop("text"), ["doc_id"], m, categories)
    return flags.withColumn("pred", F.col("pred_any")).withColumn("prob", P.hard_prob("pred"))


def phrase_cohort(
    reports: DataFrame, phrases: DataFrame, cues: DataFrame | None, categories: list[str], label: str = "gold_alt",
    demographics: list[str] = (), pred_type: str = "Phrase", texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Phrase family (op 94): negation-aware phrase flags rolled up and evaluated at three levels."""
    demographics = list(demographics)
    if texts is None:
        flagged = phrase_flag_docs(reports, phrases, cues, categories)
    else:
        flagged = attach(reports, phrase_flag_docs(texts, phrases, cues, categories))
    docs = _doc_level(flagged, label, pred_type, demographics)
    visit, pat = roll_up_levels(docs, pred_type, demographics)
    return {"docs": docs, "visits": visit, "patients": pat, "evaluation": evaluate_levels(docs, visit, pat)}


def scored_cohort(
    scored: DataFrame, label: str = "gold_alt", demographics: list[str] = (), pred_type: str = "Scored",
    threshold: float = 0.5,
) -> dict[str, DataFrame]:
    """Roll-up for ANY externally scored document table with ``score`` (op 98).

    The prediction is ``score >= threshold`` unless a ``pred`` column is given.
    """
    demographics = list(demographics)
    s = scored
    if "pred" not in s.columns:
        s = s.withColumn("pred", (F.col("score") >= threshold).cast("int"))
    s = s.withColumn("prob", F.col("score").cast("double"))
    docs = _doc_level(s, label, pred_type, demographics)
    visit, pat = roll_up_levels(docs, pred_type, demographics)
    return {"docs": docs, "visits": visit, "patients": pat, "evaluation": evaluate_levels(docs, visit, pat)}


def cohort_fairness(patients: DataFrame, demographics: list[str], reference: DataFrame | None) -> DataFrame:
    return FA.fairness_report(patients, ["dataset", "pred_type"], demographics, "pred", "gold", reference)


def compare_variants(runs: dict[str, DataFrame]) -> DataFrame:
    """Stack the evaluation of several runs (e.g. raw / standardised text) with a ``mode`` column (op 101)."""
    out = None
    for mode, df in runs.items():
        d = df.withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
