"""Scores of a user's own batch function (op 98): any model that maps batches of columns to numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def score_with(df: DataFrame, make_scorer: Callable[[], Callable], inputs: Sequence[str], out: str = "score", batch_size: int = 1024) -> DataFrame:
    """``df`` with the user's score of each row.

    ``make_scorer`` is called once per Python worker (load the model there) and returns a function of one
    numpy array per input column, ``batch_size`` rows at a time, that gives one number per row.  Null
    texts reach it as empty texts, other nulls as NaN.
    """
    scorer = predict_batch_udf(make_scorer, return_type=DoubleType(), batch_size=batch_size)
    kinds = dict(df.dtypes)
    filled = [F.coalesce(F.col(c), F.lit("")) if kinds[c] == "string" else F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in inputs]
    return df.withColumn(out, scorer(*filled))
