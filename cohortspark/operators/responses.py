"""Language-model answer analytics (ops 3, 30, 54, 68, 69).

Answers arrive as text that should hold a JSON object.  Validation, repair and
field extraction are built-in expressions (``try_parse_json`` into VARIANT,
``regexp_*``, ``try_variant_get``): no Python per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import defaults
from cohortspark.functions import jsonfix
from cohortspark.operators import rollup as R


# op 68
def repair_json(df: DataFrame, json_col: str, full_col: str | None = None) -> DataFrame:
    """Add ``answer`` (VARIANT or null), ``status`` (valid / repaired / none) and ``responded`` (an object)."""
    return jsonfix.repair_columns(df, json_col, full_col)


def _field(path_key: str, typ: str):
    return F.try_variant_get(F.col("answer"), f'$["{path_key}"]', typ)


# op 69
def parse_response(
    df: DataFrame, fields: dict | None = None, threshold: float = defaults.LIKELIHOOD_THRESHOLD,
) -> DataFrame:
    """Typed fields from the repaired object; ``pred`` = likelihood >= threshold (non-numeric -> 0).

    ``fields`` maps our names (title, features, likelihood, certainty,
    complexity) to the keys inside the answer object.
    """
    f = dict(defaults.RESPONSE_FIELDS)
    f.update(fields or {})
    like = _field(f["likelihood"], "double")
    return df.withColumns(
        {
            "title": _field(f["title"], "string"),
            "features": F.array_join(_field(f["features"], "array<string>"), ", "),
            "likelihood": like,
            "certainty": _field(f["certainty"], "string"),
            "complexity": _field(f["complexity"], "string"),
            "pred": F.coalesce((like >= F.lit(threshold)).cast("int"), F.lit(0)),
        }
    )


# op 54
def response_summary(df: DataFrame, id_col: str = "study_id", keys: list[str] = ()) -> DataFrame:
    """total, distinct patients, valid, repaired, no response, successful and predicted, with % of total.

    ``no_response`` are answers that are no object, a valid bare value among them; ``repaired`` is what valid
    and no response leave of the total, so a valid bare value lowers it by one (the original's rule).
    """
    keys = list(keys)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(id_col).alias("patients"),
        F.count_if(F.col("status") == jsonfix.STATUS_VALID).alias("valid"),
        F.count_if(~F.col("responded")).alias("no_response"),
        F.sum("pred").cast("long").alias("predicted"),
    )
    g = g.withColumns({"repaired": F.col("total") - F.col("valid") - F.col("no_response"), "successful": F.col("total") - F.col("no_response")})
    pct = {f"{c}_pct": F.round(F.col(c) * 100.0 / F.col("total"), 1) for c in ("valid", "repaired", "no_response", "successful", "predicted")}
    return g.withColumns(pct)


# op 30
def merge_with_human(
    llm: DataFrame, human: DataFrame, llm_keys: list[str], human_keys: list[str],
    llm_order: str = "ord", human_order: str = "ord", drop: list[str] = (), suffixes: tuple[str, str] = ("_human", "_llm"),
) -> DataFrame:
    """Inner join of keep-first deduplicated sides on keys with different names.

    Shared non-key names get suffixes, listed text columns are dropped, and the
    prediction of a failed answer is set to null.
    """
    l1 = R.first_per_key(llm, llm_keys, llm_order)
    h1 = R.first_per_key(human, human_keys, human_order)
    shared = (set(l1.columns) & set(h1.columns)) - set(human_keys)
    h2 = h1.select(*[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in h1.columns])
    # an LLM key with the same name as its human key becomes one column after the join
    same = {lk for hk, lk in zip(human_keys, llm_keys) if hk == lk}
    l2 = l1.select(
        *[F.col(c).alias(f"_key_{c}" if c in same else (c + suffixes[1] if c in shared else c)) for c in l1.columns]
    )
    conds = [h2[hk] == l2[f"_key_{lk}" if lk in same else lk] for hk, lk in zip(human_keys, llm_keys)]
    j = h2.join(l2, on=conds, how="inner").drop(*[f"_key_{k}" for k in same])
    j = j.drop(*[c for c in drop if c in j.columns])
    pred = "pred" + suffixes[1] if "pred" in shared else "pred"
    status = "status" + suffixes[1] if "status" in shared else "status"
    if pred in j.columns and status in j.columns:
        j = j.withColumn(pred, F.when(F.col(status) != jsonfix.STATUS_NONE, F.col(pred)))
    return j
