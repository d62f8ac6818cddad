"""Explanation tables for linear models and token attributions (ops 82-84, 86-87).

Inputs are long tables: coefficients ``(feature, coefficient)``, features
``(doc, feature, value)``, embeddings ``(item, dim, value)``, token scores
``(doc, pos, token, score)``.  Rankings are windows partitioned by a bounded key
(dimension, document) or ordered limits over small coefficient tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>")


# op 82
def feature_importance(coefs: DataFrame, top_n: int, feature_col: str = "feature", coef_col: str = "coefficient") -> DataFrame:
    """Top-n by coefficient (descending) and bottom-n (ascending), tagged ``side`` and ``rank``."""
    head = coefs.orderBy(F.col(coef_col).desc(), F.col(feature_col)).limit(top_n)
    tail = coefs.orderBy(F.col(coef_col).asc(), F.col(feature_col)).limit(top_n)
    wh = Window.orderBy(F.col(coef_col).desc(), F.col(feature_col))
    wt = Window.orderBy(F.col(coef_col).asc(), F.col(feature_col))
    return head.withColumns({"side": F.lit("positive"), "rank": F.row_number().over(wh)}).unionByName(
        tail.withColumns({"side": F.lit("negative"), "rank": F.row_number().over(wt)})
    )


# op 83
def linear_attribution(
    features: DataFrame, coefs: DataFrame, id_col: str, n_docs: int | None = None,
    feature_col: str = "term", value_col: str = "tf",
) -> tuple[DataFrame, DataFrame]:
    """Linear SHAP values phi_ij = w_j * (x_ij - mean_j) for present features, and the ranking by mean |phi|.

    Absent features (x = 0) contribute (N - df_j) * |w_j * mean_j| in closed form,
    so the sparse table is never densified.
    """
    if n_docs is None:
        n = features.agg(F.countDistinct(id_col).alias("_n")).select("_n").scalar()  # scalar subquery, no join
    else:
        n = F.lit(n_docs)
    stats = features.groupBy(feature_col).agg(F.sum(value_col).alias("_sum"), F.count(F.lit(1)).alias("_df"))
    stats = stats.withColumn("_n", n).withColumn("_mean", F.col("_sum") / F.col("_n"))
    c = coefs.select(F.col("feature").alias(feature_col), F.col("coefficient").alias("_w"))
    st = stats.join(c, on=feature_col, how="inner")
    phi = features.join(st.select(feature_col, "_w", "_mean"), on=feature_col, how="inner").select(
        id_col, feature_col, (F.col("_w") * (F.col(value_col) - F.col("_mean"))).alias("phi")
    )
    present = phi.groupBy(feature_col).agg(F.sum(F.abs("phi")).alias("_abs"))
    rank = st.join(present, on=feature_col, how="left").select(
        feature_col,
        ((F.coalesce(F.col("_abs"), F.lit(0.0)) + (F.col("_n") - F.col("_df")) * F.abs(F.col("_w") * F.col("_mean"))) / F.col("_n")).alias(
            "mean_abs_phi"
        ),
    )
    return phi, rank


# op 84
def dimension_exemplars(
    items: DataFrame, coefs: DataFrame, item_col: str, top_dims: int, k: int, dim_col: str = "dim", value_col: str = "value",
) -> DataFrame:
    """For the ``top_dims`` dimensions by |coefficient|: the top and bottom ``k`` items on each.

    ``items`` is long (item, dim, value); ``coefs`` is (dim, coefficient).
    """
    top = coefs.orderBy(F.abs(F.col("coefficient")).desc(), F.col(dim_col)).limit(top_dims)
    sel = items.join(F.broadcast(top.select(dim_col, "coefficient")), on=dim_col, how="inner")  # top_dims rows
    # two-phase top-k: first the k best/worst per (dimension, input partition), so no task
    # ever ranks all items of a dimension; then rank the <= partitions x 2k survivors.
    sel = sel.withColumn("_pid", F.spark_partition_id())
    hi1 = Window.partitionBy(dim_col, "_pid").orderBy(F.col(value_col).desc(), F.col(item_col))
    lo1 = Window.partitionBy(dim_col, "_pid").orderBy(F.col(value_col).asc(), F.col(item_col))
    sel = sel.withColumns({"_h1": F.row_number().over(hi1), "_l1": F.row_number().over(lo1)})
    sel = sel.filter((F.col("_h1") <= k) | (F.col("_l1") <= k)).drop("_pid", "_h1", "_l1")
    hi = Window.partitionBy(dim_col).orderBy(F.col(value_col).desc(), F.col(item_col))
    lo = Window.partitionBy(dim_col).orderBy(F.col(value_col).asc(), F.col(item_col))
    r = sel.withColumns({"_hi": F.row_number().over(hi), "_lo": F.row_number().over(lo)})
    return r.filter((F.col("_hi") <= k) | (F.col("_lo") <= k)).select(
        dim_col, "coefficient", item_col, value_col,
        F.when(F.col("_hi") <= k, F.lit("top")).otherwise(F.lit("bottom")).alias("side"),
        F.when(F.col("_hi") <= k, F.col("_hi")).otherwise(F.col("_lo")).alias("rank"),
    )


# op 86
def merge_subwords(
    tokens: DataFrame, id_col: str = "doc", pos_col: str = "pos", marker: str = "##", marker_role: str = "continuation",
    special=SPECIAL_TOKENS,
) -> DataFrame:
    """Join word pieces into words and add their scores: (doc, word_id, word, score, start_pos).

    ``marker_role='continuation'``: a piece starting with the marker continues the
    previous word (BERT ``##``); ``'start'``: a marker starts a new word
    (``Ġ`` / ``▁``) and pieces without it continue.  Gaps-and-islands: the word id
    is the running count of word starts in position order within the document.
    ``special`` tokens are left out before the merge, so none becomes part of a word.
    """
    tokens = tokens.filter(~F.col("token").isin(*special)) if special else tokens
    has = F.col("token").startswith(marker)
    is_start = (~has) if marker_role == "continuation" else has
    w = Window.partitionBy(id_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("_start", is_start.cast("int")).withColumn("word_id", F.sum("_start").over(w))
    piece = F.when(F.col("token").startswith(marker), F.expr(f"substring(token, {len(marker) + 1})")).otherwise(F.col("token"))
    t = t.withColumn("_piece", piece)
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col("_piece").alias("s"))))
    return t.groupBy(id_col, "word_id").agg(
        F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("word"),
        F.sum("score").alias("score"),
        F.min(pos_col).alias("start_pos"),
    )


# op 87
def top_tokens(
    words: DataFrame, id_col: str = "doc", k: int = 10, min_len: int = 4, pos_col: str = "start_pos",
) -> DataFrame:
    """Per document: drop merged words shorter than ``min_len``; top-k by |score| as
    ``word(+0.12) | word(-0.05)`` (ties by position)."""
    f = words.filter(F.length("word") >= min_len)
    w = Window.partitionBy(id_col).orderBy(F.abs("score").desc(), F.col(pos_col))
    r = f.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    parts = F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.format_string("%s(%+.2f)", F.col("word"), F.col("score")).alias("s"))))
    return r.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["s"]), " | ").alias("top_tokens"))
