"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id).  A size-weighted sample of keys gives quantile
boundaries; rows go to the ranges between them; ranges that turn out overfull are sampled
again and subdivided.  Exact byte counts per range then place the shard borders, and only
rows inside a range are sorted.  Equal texts lie next to each other and share a shard, unless
their group is larger than ``split_share`` of a shard: then it is cut between rows.

Defined cases: null text has size 1; an empty table gives an empty result; repeated rows are
separate rows with their own slots; null ids sort first.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import saved, text_or_empty

#: Sampled keys per range, and the rows that a range should hold at most.
OVERSAMPLE, RANGE_ROWS = 40, 1_000_000


def _sample(rows: DataFrame, total: float, wanted: int) -> list[tuple]:
    """(hash, id, weight it stands for): a row is drawn with a chance in proportion to its weight.

    About ``wanted`` rows come to the driver whatever the table's size.
    """
    chance = F.col("weight") * F.lit(wanted / total)
    drawn = F.pmod(F.xxhash64(F.lit(17), "hash", "doc_id", "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.filter(drawn < chance).select("hash", "doc_id", "weight").collect()
    step = total / wanted
    return sorted((r["hash"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], max(step, r["weight"])) for r in got)


def _splitters(sample: list[tuple], parts: int) -> list[tuple]:
    """Quantile boundaries; one boundary in a group of equal texts moves to the group's start."""
    if not sample or parts < 2:
        return []
    reach = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts)
    picked = sorted({sample[min(i, len(sample) - 1)][:2] for i in at})
    per_group: dict = {}
    for h, i in picked:
        per_group.setdefault(h, []).append(i)
    low = -(1 << 63)
    return sorted((h, i) for h, ids in per_group.items() for i in ([low] if len(ids) == 1 else [low, *ids]))


def _with_range(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Number each row by the boundaries at or below it."""
    keys = np.array([h for h, _ in bounds], np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        own = h.to_numpy(np.int64)
        lo, out = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        for k in np.flatnonzero(lo != out):  # a boundary lies in this row's group: ids decide
            out[k] = bisect.bisect_right(bounds, (int(own[k]), int(i.iloc[k])), int(lo[k]), int(out[k]))
        return pd.Series(out.astype(np.int32))

    return rows.withColumn("range", place("hash", F.coalesce("doc_id", F.lit(-(1 << 63)))))


def shard(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", split_share: float = 0.02,
    min_ranges: int = 64,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards hold near equal bytes, slots are gapless from 0."""
    text = text_or_empty(text_col)
    rows = saved(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    # Half bytes, half rows: neither long texts nor many tiny ones fill a range.
    weighed = rows.withColumn("weight", F.col("size") / F.lit(float(total)) + F.lit(1.0 / n))
    parts = max(min_ranges, -(-n // RANGE_ROWS))
    bounds = _splitters(_sample(weighed, 2.0, parts * OVERSAMPLE), parts)
    while True:
        placed = _with_range(weighed, bounds)
        filled = placed.groupBy("range").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
        overfull = {r["range"]: max(2, round(r["w"] * parts / 2)) for r in filled if r["w"] > 2 * 2.0 / parts and r["n"] > 1}
        more: set = set()
        for r, pieces in overfull.items():
            weight = next(x["w"] for x in filled if x["range"] == r)
            more |= set(_splitters(_sample(placed.filter(F.col("range") == r), weight, pieces * OVERSAMPLE), pieces))
        if not more - set(bounds):
            break
        bounds = sorted(more | set(bounds))
    begin = np.cumsum([0, *[r["size"] for r in sorted(filled, key=lambda r: r["range"])]])
    starts = docs.sparkSession.createDataFrame(
        [(r["range"], int(b)) for r, b in zip(sorted(filled, key=lambda r: r["range"]), begin)], "range int, begin bigint"
    )
    # As many rows as ranges: the size of this side is fixed by RANGE_ROWS.
    placed = placed.join(F.broadcast(starts), "range")
    in_range = Window.partitionBy("range").orderBy("hash", "doc_id", "size")
    before = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1))
    group = Window.partitionBy("range", "hash")
    placed = placed.withColumn("row_at", F.col("begin") + F.coalesce(before, F.lit(0)))
    placed = placed.withColumn("group_at", F.min("row_at").over(group)).withColumn("group_size", F.sum("size").over(group))
    # What is placed whole goes where its middle lies.
    at = F.when(F.col("group_size") > F.lit(int(split_share * total / n_shards)), F.col("row_at") + F.col("size") / 2)
    at = at.otherwise(F.col("group_at") + F.col("group_size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(at * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int"))
    placed = saved(
        placed.withColumn("nth", F.row_number().over(Window.partitionBy("range", "shard").orderBy("hash", "doc_id", "size")))
        .select("doc_id", "size", "text_crc32", "shard", "range", "nth"),
        "shard-placed",
    )
    held = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("shard", "range", offset.alias("offset"))
    return placed.join(F.broadcast(held), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot")
    )
