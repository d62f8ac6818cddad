"""Readers: report tables, concept files, batch answer files (ops 1-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.schema import ReportSchema

# Concept rows are pipe-separated with at least 15 fields; the ones used are
# 0 concept id, 1 language, 2 term status, 6 preferred flag, 12 term kind, 14 string.
CONCEPT_FIELDS = [
    "CUI", "LAT", "TS", "LUI", "STT", "SUI", "ISPREF", "AUI", "SAUI", "SCUI",
    "SDUI", "SAB", "TTY", "CODE", "STR", "SRL", "SUPPRESS", "CVF",
]


def load_reports(
    spark: SparkSession,
    path: str,
    schema: ReportSchema | None = None,
    fmt: str | None = None,
    read_schema: T.StructType | None = None,
    preprocess: bool = True,
) -> DataFrame:
    """Read a report table (CSV with header, or Parquet/JSON/ORC by extension) and preprocess it."""
    from cohortspark.operators import prep

    schema = schema or ReportSchema()
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else path.rsplit(".", 1)[-1].lower())
    reader = spark.read
    if read_schema is not None:
        reader = reader.schema(read_schema)
    if fmt == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif fmt in ("parquet", "json", "orc"):
        df = reader.format(fmt).load(path)
    else:
        df = reader.parquet(path)
    return prep.preprocess(df, schema) if preprocess else df


def load_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Read a pipe-delimited concept file; rows with fewer than 15 fields are skipped.

    Adds ``ord`` = (file, byte offset) order so that order-dependent rules
    (first preferred string, last concept wins) are deterministic.
    """
    raw = spark.read.text(path).select(F.col("value"), _file_order().alias("ord"))
    parts = F.split(F.col("value"), r"\|", -1)
    cols = [parts.getItem(i).alias(name) for i, name in enumerate(CONCEPT_FIELDS[:15])]
    return raw.filter(F.size(parts) >= 15).select(*cols, "ord")


def _file_order():
    """Sort key for "position in the input": (file, block offset, row within the block).

    Rows of one split are read in order, so the monotonically increasing id orders
    them within the block; file and block offset order the blocks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_batches(spark: SparkSession, glob: str, fmt: str = "csv", **options) -> DataFrame:
    """Read every batch file matching ``glob``; ``batch_file`` and ``ord`` give the name order.

    ``ord`` sorts by file name first and by position inside the file second, the
    order in which the batch files were concatenated.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(glob)
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("batch_file"),
        _file_order().alias("ord"),
    )
