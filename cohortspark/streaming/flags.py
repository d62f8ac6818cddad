"""Flag report texts arriving as files, with the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortspark.operators import match as MT


def read_report_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """File-source stream of report rows (new files in ``path`` are picked up as they land)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def flag_stream(stream: DataFrame, vocab: DataFrame, text_col: str = "text", whole_word: bool = True) -> DataFrame:
    """Add ``pred_<category>`` columns to a streaming DataFrame (stateless projection)."""
    return MT.regex_flags(stream, vocab, text_col, whole_word=whole_word)


def start_flag_sink(flagged: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet", once: bool = False):
    """Append flagged rows to ``out_path``; progress is kept in ``checkpoint`` (shared storage)."""
    w = flagged.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if once else w
    return w.start(out_path)
