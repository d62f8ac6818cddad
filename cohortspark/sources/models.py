"""A versioned store of models whose weights are tables (term weights, indexes, features).

A version is a folder of Parquet tables.  It counts once its row is in the register, one small file
that a single committed job appends: a writer lost before that leaves the former version in force,
and readers never see half a model.  Loading checks every table against the schema it was saved with.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REGISTER = "version string, at bigint, tables string"


def _fields(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def save_model(path: str, tables: dict[str, DataFrame]) -> str:
    """Writes a new version below ``path`` (shared storage) and makes it the current one; returns its name."""
    spark = next(iter(tables.values())).sparkSession
    version, path = uuid.uuid4().hex, path.rstrip("/")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    row = (version, time.time_ns(), json.dumps({name: _fields(df.schema) for name, df in tables.items()}))
    spark.createDataFrame([row], REGISTER).coalesce(1).write.mode("append").parquet(f"{path}/register")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTER).parquet(f"{path.rstrip('/')}/register")


def load_model(spark: SparkSession, path: str, version: str | None = None, needs: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The tables of ``version`` (default: the newest).

    ValueError if the version is unknown, a table's columns are not those it was saved with, or a
    table or column of ``needs`` is absent.
    """
    rows = versions(spark, path)
    row = (rows if version is None else rows.filter(F.col("version") == version)).orderBy(F.desc("at"), "version").first()
    if row is None:
        raise ValueError(f"no version {version or ''} of a model in {path}")
    out = {}
    for name, fields in json.loads(row["tables"]).items():
        out[name] = spark.read.parquet(f"{path.rstrip('/')}/{row['version']}/{name}")
        if _fields(out[name].schema) != [tuple(f) for f in fields]:
            raise ValueError(f"table {name} of model {row['version']} has other columns than it was saved with")
    for name, columns in (needs or {}).items():
        lacking = [c for c in columns if name not in out or c not in out[name].columns]
        if lacking:
            raise ValueError(f"model {row['version']} lacks {name}: {', '.join(lacking)}")
    return out
