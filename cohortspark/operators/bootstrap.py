"""Percentile bootstrap intervals for F1 and MCC from confusion counts (op 40).

Class-stratified resampling keeps the number of positives ``P = tp + fn`` and
negatives ``N = tn + fp``; a resample's true positives are then
``Bin(P, tp / P)`` and its true negatives ``Bin(N, tn / N)``, independent, and
F1 / MCC depend on the four counts only.  Drawing two binomials per replicate is
therefore exact in distribution and costs O(keys x replicates), whatever the
number of rows.

Replicates are generated row-locally (``explode(sequence(0, n_boot - 1))``, no
cross join); the draws run in one Arrow-batched pandas UDF whose random stream
is seeded per (key, replicate), so results do not depend on partitioning.  A key
with a single class yields a null interval (every stratified draw would be
single-class, which the original procedure rejects).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark import defaults
from cohortspark.functions import stats


@F.pandas_udf(T.LongType())
def _binomial(n: pd.Series, p: pd.Series, seed: pd.Series) -> pd.Series:
    out = np.empty(len(n), dtype=np.int64)
    for i, (nn, pp, ss) in enumerate(zip(n.to_numpy(), p.to_numpy(), seed.to_numpy())):
        out[i] = np.random.default_rng(int(ss) & 0x7FFFFFFFFFFFFFFF).binomial(int(nn), float(pp)) if nn > 0 else 0
    return pd.Series(out)


METRICS = {
    "f1": lambda tp, fp, fn, tn: stats.f1(tp, fp, fn),
    "mcc": lambda tp, fp, fn, tn: stats.mcc(tp, fp, fn, tn),
}


def bootstrap_ci(
    counts: DataFrame, keys: list[str], metrics=("f1", "mcc"), n_boot: int = defaults.BOOTSTRAP_REPLICATES,
    seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """Per key and metric: point estimate and percentile interval (lo, hi) over ``n_boot`` replicates."""
    P = F.col("tp") + F.col("fn")
    N = F.col("tn") + F.col("fp")
    key_hash = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed))
    reps = counts.select(*keys, "tp", "fp", "fn", "tn", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    reps = reps.withColumns(
        {
            "_tp": _binomial(P, F.when(P > 0, F.col("tp") / P).otherwise(0.0), F.xxhash64(key_hash, F.col("rep"), F.lit(1))),
            "_tn": _binomial(N, F.when(N > 0, F.col("tn") / N).otherwise(0.0), F.xxhash64(key_hash, F.col("rep"), F.lit(2))),
        }
    )
    bt = reps.select(*keys, "rep", "_tp", (N - F.col("_tn")).alias("_fp"), (P - F.col("_tp")).alias("_fn"), "_tn", P.alias("_P"), N.alias("_N"))
    rows = []
    for m in metrics:
        f = METRICS[m]
        est = f(F.col("_tp"), F.col("_fp"), F.col("_fn"), F.col("_tn"))
        rows.append(F.struct(F.lit(m).alias("metric"), est.alias("v")))
    long = bt.select(*keys, "_P", "_N", F.explode(F.array(*rows)).alias("x")).select(*keys, "_P", "_N", "x.metric", "x.v")
    ci = long.groupBy(*keys, "metric").agg(
        F.percentile(F.col("v"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"),
        F.min("_P").alias("_P"), F.min("_N").alias("_N"),
    )
    two = (F.col("_P") > 0) & (F.col("_N") > 0)
    ci = ci.select(*keys, "metric", F.when(two, F.col("_q")[0]).alias("lo"), F.when(two, F.col("_q")[1]).alias("hi"))
    point = counts.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), METRICS[m]("tp", "fp", "fn", "tn").alias("estimate")) for m in metrics])).alias("p"),
    ).select(*keys, "p.metric", "p.estimate")
    return point.join(ci, on=[*keys, "metric"], how="left")


#: Distinct scores of a block, and replicates worked on at a time inside it.
AP_BLOCK, AP_REPLICATES = 1 << 16, 50


def _seed(*parts) -> np.random.Generator:
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=16).digest()
    return np.random.default_rng(np.frombuffer(digest, np.uint64))


def _split_draws(rows: pa.Table, keys: list[str], n_boot: int, seed: int) -> pa.Table:
    """Blocks of one key, best scores first: each replicate's positives and negatives in the block and before it."""
    rows = rows.sort_by("block")
    rng = _seed(seed, *[rows.column(k)[0].as_py() for k in keys])
    out = {}
    for name in ("pos", "neg"):
        size = rows.column(name).to_numpy()
        left, rest, before = np.full(n_boot, size.sum()), size.sum(), np.zeros(n_boot, np.int64)
        draws, befores = [], []
        for n in size.tolist():  # a block takes its share of what is left: together, a multinomial draw
            d = rng.binomial(left, min(1.0, n / rest)) if rest else np.zeros(n_boot, np.int64)
            draws.append(d.astype("<i8").tobytes())
            befores.append(before.astype("<i8").tobytes())
            before, left, rest = before + d, left - d, rest - n
        out |= {f"{name}_draw": pa.array(draws, pa.binary()), f"{name}_before": pa.array(befores, pa.binary())}
    table = rows.select([*keys, "block"])
    for name, column in out.items():
        table = table.append_column(name, column)
    return table.append_column("total", pa.array([int(rows.column("pos").to_numpy().sum())] * rows.num_rows, pa.int64()))


def _block_precision(cells: pa.Table, block: pa.Table, keys: list[str], n_boot: int, seed: int) -> pa.Table:
    """One block: its part of every replicate's average precision, as one vector."""
    cells = cells.sort_by("pos")
    first = block.slice(0, 1)
    rng = _seed(seed, "cells", first.column("block")[0].as_py(), *[first.column(k)[0].as_py() for k in keys])
    vector = lambda c: np.frombuffer(first.column(c)[0].as_py(), "<i8")
    count = {c: cells.column(c).to_numpy() for c in ("npos", "nneg")}
    share = {c: v / v.sum() if v.sum() else v.astype(float) for c, v in count.items()}
    total = first.column("total")[0].as_py()
    part = np.zeros(n_boot)
    for at in range(0, n_boot, AP_REPLICATES):
        now = slice(at, at + AP_REPLICATES)
        draw = {}
        for c, name in (("npos", "pos"), ("nneg", "neg")):
            n = vector(f"{name}_draw")[now]
            draw[c] = rng.multinomial(n, share[c]) if count[c].sum() else np.zeros((len(n), len(count[c])), np.int64)
        tp = vector("pos_before")[now][:, None] + np.cumsum(draw["npos"], axis=1)
        seen = tp + vector("neg_before")[now][:, None] + np.cumsum(draw["nneg"], axis=1)
        part[now] = (draw["npos"] / max(total, 1) * tp / np.maximum(seen, 1)).sum(axis=1)
    table = first.select(keys)
    return table.append_column("part", pa.array([part.astype("<f8").tobytes()], pa.binary()))


def _interval(parts: pa.Table, keys: list[str], alpha: float) -> pa.Table:
    total = sum(np.frombuffer(p, "<f8") for p in parts.column("part").to_pylist())
    lo, hi = np.quantile(total, [alpha / 2, 1 - alpha / 2])
    return parts.slice(0, 1).select(keys).append_column("lo", pa.array([lo])).append_column("hi", pa.array([hi]))


def bootstrap_pr_auc(
    df: DataFrame, keys: list[str], label: str, score: str, n_boot: int = defaults.BOOTSTRAP_REPLICATES,
    seed: int = 0, alpha: float = 0.05, block: int = AP_BLOCK,
) -> DataFrame:
    """Average precision with a percentile interval from a stratified bootstrap: both class totals stay as they are.

    Rows become counts per distinct score; these are numbered by range partitions, best score
    first, and cut into blocks of ``block`` scores.  Each replicate's positives and negatives
    are dealt to the blocks (a multinomial draw over the block totals) and inside a block to its scores, so
    the draws of all blocks together are one stratified resample.  A block holds its replicates as one
    vector and yields one vector of partial sums; no row is made per replicate.  Keys with one class only: null.
    """
    from cohortspark.operators import metrics as M
    from cohortspark.operators.ranks import with_positions

    hist = M.score_histogram(df, keys, label, label, score)
    point = M.average_precision_from_hist(hist, keys).withColumnRenamed("pr_auc", "estimate")
    cells = hist.groupBy(*keys, "s").agg(F.sum(F.col("y") * F.col("cnt")).cast("bigint").alias("npos"), F.sum((1 - F.col("y")) * F.col("cnt")).cast("bigint").alias("nneg"))
    cells = with_positions(cells.withColumn("_down", -F.col("s")), keys, ["_down"], "pos").withColumn("block", F.expr(f"pos div {block}")).drop("_down", "s")
    kind = {f.name: f.dataType.simpleString() for f in cells.schema}
    named = [f"`{k}` {kind[k]}" for k in keys]
    totals = cells.groupBy(*keys, "block").agg(F.sum("npos").alias("pos"), F.sum("nneg").alias("neg"))
    draws = totals.groupBy(*keys).applyInArrow(
        lambda t: _split_draws(t, keys, n_boot, seed),
        ", ".join([*named, "block bigint", "pos_draw binary", "pos_before binary", "neg_draw binary", "neg_before binary", "total bigint"]),
    )
    parts = cells.groupBy(*keys, "block").cogroup(draws.groupBy(*keys, "block")).applyInArrow(
        lambda a, b: _block_precision(a, b, keys, n_boot, seed), ", ".join([*named, "part binary"])
    )
    ci = parts.groupBy(*keys).applyInArrow(lambda t: _interval(t, keys, alpha), ", ".join([*named, "lo double", "hi double"]))
    out = point.join(ci, on=keys, how="left")
    return out.withColumns({"lo": F.when(F.col("estimate").isNotNull(), F.col("lo")), "hi": F.when(F.col("estimate").isNotNull(), F.col("hi"))})
