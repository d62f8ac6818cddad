"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its row count is proven below this bound.
BROADCAST_MAX_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join to the planner.

    The count is a distributed action over a dimension-sized table (vocabularies,
    mappings, concept subsets).  Beyond the bound the join stays a shuffled
    sort-merge join that AQE may still convert or split by runtime size.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
