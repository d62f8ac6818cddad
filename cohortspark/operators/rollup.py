"""Roll-ups from documents to visits and patients (ops 20-22, 26-29, 35-36, 43, 58).

Roll-ups are ``groupBy`` aggregates: max/min/min_by are partially aggregated on
the map side, so a patient holding a third of all rows costs one partial row
per input partition, not one hot task.  Values broadcast back to rows use an
aggregate + equi-join instead of a window (a window would pull a hot patient
into one task; the join's big side can be split by AQE skew handling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# op 20 (wide form)
def row_or(*cols) -> Column:
    """Row-wise OR (max) over columns; nulls skipped; all null -> 0."""
    cs = [_c(c) for c in cols]
    g = F.greatest(*cs) if len(cs) > 1 else cs[0]
    return F.coalesce(g, F.lit(0))


# op 20 (long form)
def cumulative_or(
    df: DataFrame, keys: list[str], preds: list[str] = (), probs: list[str] = (), golds: list[str] = (),
) -> DataFrame:
    """Per key (e.g. visit): max of predictions/probabilities, null -> 0; gold = any (null as false)."""
    aggs = [F.coalesce(F.max(p), F.lit(0)).cast("int").alias(p) for p in preds]
    aggs += [F.coalesce(F.max(p), F.lit(0.0)).cast("double").alias(p) for p in probs]
    aggs += [F.coalesce(F.max(g), F.lit(0)).cast("int").alias(g) for g in golds]
    return df.groupBy(*keys).agg(*aggs)


# op 22
def final_flag(*cols) -> Column:
    """1 if any flag in the row is >= 1, else 0."""
    cs = [_c(c) for c in cols]
    g = F.greatest(*cs) if len(cs) > 1 else cs[0]
    return F.coalesce((g >= 1).cast("int"), F.lit(0))


# op 26
def patient_flag_per_report(
    df: DataFrame, flag: str, id_col: str = "study_id", report_col: str = "report_col", out: str = "patient_flag",
) -> DataFrame:
    """Max of a report flag over the patient's rows of the same report column, joined back (row count kept)."""
    per = df.groupBy(id_col, report_col).agg(F.max(flag).alias(out))
    return df.join(per, on=[id_col, report_col], how="left")


# op 27
def patient_final_flag(df: DataFrame, flags: list[str], id_col: str = "study_id", out: str = "final_prediction") -> DataFrame:
    """1 if any flag of any row of the patient is set, joined back to every row."""
    per = df.groupBy(id_col).agg(F.coalesce(F.max(final_flag(*flags)), F.lit(0)).alias(out))
    return df.join(per, on=id_col, how="left")


# op 28
def attach_patient_score(
    patients: DataFrame, rows: DataFrame, score: str, id_col: str = "study_id", out: str | None = None,
) -> DataFrame:
    """Max score per patient from ``rows`` looked up onto ``patients``; missing -> 0."""
    out = out or score
    per = rows.groupBy(id_col).agg(F.max(score).alias("_s"))
    return patients.join(per, on=id_col, how="left").withColumn(out, F.coalesce(F.col("_s"), F.lit(0.0))).drop("_s")


# op 35
def collapse_patients(
    df: DataFrame, flags: list[str], demographics: list[str] = (), id_col: str | list[str] = "study_id",
    order_col: str = "ord", fill_null: bool = True,
) -> DataFrame:
    """One row per patient: max of flags (null -> 0 first), first non-null demographic by row order."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    aggs = []
    for f in flags:
        v = F.coalesce(F.col(f), F.lit(0)) if fill_null else F.col(f)
        aggs.append(F.max(v).alias(f))
    for d in demographics:
        aggs.append(F.min_by(F.col(d), F.when(F.col(d).isNotNull(), F.col(order_col))).alias(d))
    return df.groupBy(*ids).agg(*aggs)


# op 36
def patient_gold(df: DataFrame, labels: list[str], id_col: str = "study_id", out: str = "patient_gold", fill: int | None = 0) -> DataFrame:
    """Patient gold = max over rows of the max over report labels (null -> ``fill``)."""
    g = F.greatest(*[F.col(l) for l in labels]) if len(labels) > 1 else F.col(labels[0])
    m = F.max(g)
    return df.groupBy(id_col).agg((F.coalesce(m, F.lit(fill)) if fill is not None else m).cast("int").alias(out))


# op 43
def patient_text(
    df: DataFrame, text_col: str = "text", id_col: str = "study_id", order_col: str = "ord", out: str = "patient_text",
) -> DataFrame:
    """Per patient, the row texts joined by one space in row order (null text as '').

    The output is one string per patient by definition; ordering uses an explicit
    order column (rows have no order of their own).
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
    return df.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias(out))


# op 58
def first_per_key(df: DataFrame, keys: list[str], order_col: str = "ord") -> DataFrame:
    """Keep the first row per key by ``order_col``.

    ``min_by(struct(row), ord)`` is a partial aggregate: a key with a third of
    all rows is reduced on the map side instead of sorting it in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col)).alias("_first")
    return df.groupBy(*keys).agg(agg).select(*keys, "_first.*")


# op 29
def patient_text_labels(
    df: DataFrame, label_col: str, text_col: str = "text", id_col: str = "study_id", order_col: str = "ord",
) -> DataFrame:
    """Patient text left-joined to the label of the patient's first row."""
    txt = patient_text(df, text_col, id_col, order_col)
    first = first_per_key(df.select(id_col, order_col, label_col), [id_col], order_col).select(id_col, label_col)
    return txt.join(first, on=id_col, how="left")
