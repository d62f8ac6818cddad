"""Fairness audit by demographic group (ops 23, 34, 47-53, 88-89).

Attributes are unpivoted to ``(attribute, grp)`` rows so that every attribute
and group is evaluated by ONE ``groupBy``; the per-attribute "all" rows are the
sum of the group counts (counts are additive), so no second pass over the data.
Reference-group rules run on the tiny group table.

Reference rules (per attribute):
* demographic parity = rate - rate_ref, with ref = the given group if present
  and its rate > 0, else the first group (sorted) with rate > 0; needs >= 2 groups;
* equal opportunity = |TPR - TPR_ref|, ref = the given group if present, else
  the first group (sorted); TPR null for a group without positives;
* disparate impact = rate / rate_ref, only with the given group present;
  null when the reference rate is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import stats
from cohortspark.operators import metrics as M
from cohortspark.operators.joins import bounded_broadcast


def unpivot_attributes(df: DataFrame, keys: list[str], attrs: list[str], cols: list[str], null_as_group: bool = False) -> DataFrame:
    """(keys, cols) x attrs -> (keys, attribute, grp, cols); null groups dropped unless ``null_as_group``."""
    present = [a for a in attrs if a in df.columns]
    entries = [
        F.struct(F.lit(a).alias("attribute"),
                 (F.coalesce(F.col(a).cast("string"), F.lit("nan")) if null_as_group else F.col(a).cast("string")).alias("grp"))
        for a in present
    ]
    out = df.select(*keys, *cols, F.explode(F.array(*entries)).alias("_a")).select(*keys, "_a.attribute", "_a.grp", *cols)
    return out.filter(F.col("grp").isNotNull())


# op 47 / 48 inputs
def group_counts(df: DataFrame, keys: list[str], attrs: list[str], pred: str, gold: str, null_as_group: bool = False) -> DataFrame:
    long = unpivot_attributes(df, keys, attrs, [pred, gold], null_as_group)
    long = long.filter(F.col(pred).isNotNull() & F.col(gold).isNotNull())
    return M.confusion(long, [*keys, "attribute", "grp"], gold, pred)


def group_rates(counts: DataFrame) -> DataFrame:
    """Positive-prediction rate and TPR (null without positives) per group (ops 47, 48)."""
    return counts.withColumns(
        {
            "rate": stats.ratio(F.col("tp") + F.col("fp"), F.col("n")),
            "tpr": stats.ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )


def _refs(rates: DataFrame, keys: list[str], reference: DataFrame | None) -> DataFrame:
    """Attach the reference group (op 34) and the three chosen references per attribute."""
    part = [*keys, "attribute"]
    if reference is not None:
        r = rates.join(bounded_broadcast(reference.select("attribute", F.col("ref_group").alias("_given"))), on="attribute", how="left")
    else:
        r = rates.withColumn("_given", F.lit(None).cast("string"))
    w = Window.partitionBy(*part)
    is_given = F.col("grp") == F.col("_given")
    r = r.withColumns(
        {
            "_ngroups": F.count(F.lit(1)).over(w),
            "dp_ref": F.coalesce(
                F.max(F.when(is_given & (F.col("rate") > 0), F.col("grp"))).over(w),
                F.min(F.when(F.col("rate") > 0, F.col("grp"))).over(w),
            ),
            "eo_ref": F.coalesce(F.max(F.when(is_given, F.col("grp"))).over(w), F.min("grp").over(w)),
            "di_ref": F.max(F.when(is_given, F.col("grp"))).over(w),
        }
    )
    return r.withColumns(
        {
            "_dp_rate": F.max(F.when(F.col("grp") == F.col("dp_ref"), F.col("rate"))).over(w),
            "_eo_tpr": F.max(F.when(F.col("grp") == F.col("eo_ref"), F.col("tpr"))).over(w),
            "_di_rate": F.max(F.when(F.col("grp") == F.col("di_ref"), F.col("rate"))).over(w),
        }
    )


def comparisons(rates: DataFrame, keys: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Per non-reference group: parity difference, opportunity gap, impact ratio (ops 49-51)."""
    r = _refs(rates, keys, reference)
    dp_ok = (F.col("_ngroups") >= 2) & F.col("dp_ref").isNotNull() & (F.col("grp") != F.col("dp_ref"))
    eo_ok = F.col("grp") != F.col("eo_ref")
    di_ok = F.col("di_ref").isNotNull() & (F.col("grp") != F.col("di_ref"))
    return r.withColumns(
        {
            "dp_ref": F.when(F.col("_ngroups") >= 2, F.col("dp_ref")),
            "demographic_parity": F.when(dp_ok, F.col("rate") - F.col("_dp_rate")),
            "equal_opportunity": F.when(eo_ok, F.abs(F.col("tpr") - F.col("_eo_tpr"))),
            "disparate_impact": F.when(di_ok & (F.col("_di_rate") > 0), F.col("rate") / F.col("_di_rate")),
        }
    ).drop("_given", "_ngroups", "_dp_rate", "_eo_tpr", "_di_rate")


def demographic_parity(df, keys, attrs, pred, gold, reference=None) -> DataFrame:
    c = comparisons(group_rates(group_counts(df, keys, attrs, pred, gold)), keys, reference)
    return c.select(*keys, "attribute", "grp", "dp_ref", "demographic_parity")


def equal_opportunity(df, keys, attrs, pred, gold, reference=None) -> DataFrame:
    c = comparisons(group_rates(group_counts(df, keys, attrs, pred, gold)), keys, reference)
    return c.select(*keys, "attribute", "grp", "eo_ref", "equal_opportunity")


def disparate_impact(df, keys, attrs, pred, gold, reference=None) -> DataFrame:
    c = comparisons(group_rates(group_counts(df, keys, attrs, pred, gold)), keys, reference)
    return c.select(*keys, "attribute", "grp", "di_ref", "disparate_impact")


FAIRNESS_COLUMNS = ["rate", "tpr", "dp_ref", "demographic_parity", "eo_ref", "equal_opportunity", "di_ref", "disparate_impact"]


# op 52
def fairness_report(
    df: DataFrame, keys: list[str], attrs: list[str], pred: str, gold: str,
    reference: DataFrame | None = None, null_as_group: bool = False, alpha: float = 0.05,
    f1_interval: bool = False, n_boot: int = 1000, seed: int = 0,
) -> DataFrame:
    """Per attribute one 'all' row and one row per observed group.

    Every row has counts, metrics and Wilson bounds (0/0 specificity/NPV -> 0,
    the audit convention); group rows carry the comparisons with the
    reference group, the 'all' row carries null comparisons (see
    ``fairness_maps`` for the per-attribute maps).
    """
    counts = group_counts(df, keys, attrs, pred, gold, null_as_group)
    groups = comparisons(group_rates(counts), keys, reference).withColumn("level", F.lit("group"))
    alls = counts.groupBy(*keys, "attribute").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn")])
    alls = group_rates(alls.withColumn("grp", F.lit("all"))).withColumns(
        {c: F.lit(None).cast("string" if c.endswith("_ref") else "double") for c in FAIRNESS_COLUMNS if c not in ("rate", "tpr")}
    ).withColumn("level", F.lit("all"))
    cols = [*keys, "attribute", "level", "grp", "n", "tp", "fp", "fn", "tn", *FAIRNESS_COLUMNS]
    both = groups.select(*cols).unionByName(alls.select(*cols))
    out = M.classification_metrics(both, alpha, zero_division="zero")
    if f1_interval:
        # bootstrap F1 interval per row from its counts (replicates by explode, no data re-read)
        from cohortspark.operators.bootstrap import bootstrap_ci

        k = [*keys, "attribute", "level", "grp"]
        ci = bootstrap_ci(out.select(*k, "tp", "fp", "fn", "tn"), k, ("f1",), n_boot, seed, alpha)
        out = out.join(ci.select(*k, F.col("lo").alias("f1_lo"), F.col("hi").alias("f1_hi")), on=k, how="left")
    return out


def fairness_maps(report: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, attribute): the three comparison maps as JSON strings, keyed like
    ``Demographic_Parity_<attr>_Group_<grp>_vs_<ref>`` (op 52's sink form)."""
    g = report.filter(F.col("level") == "group")

    def entries(prefix, val, ref):
        name = F.concat(F.lit(prefix + "_"), F.col("attribute"), F.lit("_Group_"), F.col("grp"), F.lit("_vs_"), F.col(ref))
        return F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col(ref).isNotNull() & (F.col("grp") != F.col(ref)), F.struct(name.alias("k"), F.col(val).alias("v")))))
        )

    return g.groupBy(*keys, "attribute").agg(
        F.to_json(entries("Demographic_Parity", "demographic_parity", "dp_ref")).alias("Demographic_Parity"),
        F.to_json(entries("Equal_Opportunity", "equal_opportunity", "eo_ref")).alias("Equal_Opportunity"),
        F.to_json(entries("Disparate_Impact", "disparate_impact", "di_ref")).alias("Disparate_Impact"),
    )


# op 53
def distinct_groups(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


# op 88
def natural_order(c) -> list[Column]:
    """Sort keys: numeric value first when the group parses as a number, then the text."""
    c = F.col(c) if isinstance(c, str) else c
    return [c.try_cast("double").asc_nulls_last(), c.asc()]


# op 89
def fairness_long(report: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attribute, group, comparison, reference, value) from the group rows; the key
    ``A_vs_B`` of the map form becomes the text ``A vs B``."""
    g = report.filter(F.col("level") == "group")
    entries = F.array(
        F.struct(F.lit("Demographic_Parity").alias("comparison"), F.col("dp_ref").alias("reference"), F.col("demographic_parity").alias("value")),
        F.struct(F.lit("Equal_Opportunity").alias("comparison"), F.col("eo_ref").alias("reference"), F.col("equal_opportunity").alias("value")),
        F.struct(F.lit("Disparate_Impact").alias("comparison"), F.col("di_ref").alias("reference"), F.col("disparate_impact").alias("value")),
    )
    x = g.select(*keys, "attribute", "grp", F.explode(entries).alias("e")).select(*keys, "attribute", "grp", "e.*")
    x = x.filter(F.col("reference").isNotNull() & (F.col("grp") != F.col("reference")))
    return x.withColumn("label", F.concat(F.col("grp"), F.lit(" vs "), F.col("reference")))
