"""Places of rows in a global order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import saved_table


def with_positions(df: DataFrame, group_cols: list[str], order_cols: list[str], pos: str = "pos", total: str | None = None) -> DataFrame:
    """``df`` with the place (from 0) of each row in its group, and the group's size as ``total``.

    Rows are range-partitioned by (group, order) from sampled splitters and written once, so that
    their places inside a partition are fixed; a table of (partition, group) counts, prefix-summed
    by partition, gives the offsets.  Ties get places in any order; nulls sort first and a null
    group column is a group of its own.
    """
    keys = [*group_cols, *order_cols]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The high 31 bits of this id are the partition, the low 33 the place in it.
    rows = saved_table(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_part", *group_cols).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(Window.partitionBy(*group_cols)))
    offsets = counts.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "_off", *([total] if total else [])
    )
    same = rows["_part"] == offsets["_p"]
    for i, c in enumerate(group_cols):
        same = same & rows[c].eqNullSafe(offsets[f"_g{i}"])
    out = rows.join(offsets, same).withColumn(pos, F.col("_at") + F.col("_off"))
    return out.select(*df.columns, pos, *([total] if total else []))
