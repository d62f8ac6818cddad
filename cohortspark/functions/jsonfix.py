"""JSON answer validation and repair, as built-in expressions (VARIANT parsing).

Status of an answer:
* ``valid``    – the stored JSON text parses, whatever its value (a bare number has no fields, so it
  counts as valid and predicts 0; ``responded`` is false);
* ``repaired`` – the full answer, cut from its first ``{`` to its last ``}``,
  with ``//`` comments and trailing commas removed, parses to an object;
* ``none``     – anything else (no braces or unparseable).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_VALID, STATUS_REPAIRED, STATUS_NONE = "valid", "repaired", "none"


def _is_object_text(s: Column) -> Column:
    return F.ltrim(s).startswith("{")


def repaired_text(full: Column) -> Column:
    """First ``{`` to last ``}`` (dot matches newline), comments to end of line cut, trailing commas dropped."""
    body = F.regexp_extract(full, r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(body, r"//[^\n\r]*", "")
    body = F.regexp_replace(body, r",\s*\}", "}")
    body = F.regexp_replace(body, r",\s*\]", "]")
    return F.when(body != "", body)


def repair_columns(df, json_col: str, full_col: str | None = None):
    """Add ``answer``, ``status`` and ``responded`` (is the answer an object?) parsing each text once: parse results are
    materialised as columns first, then combined (avoids repeated JSON parsing)."""
    full = json_col if full_col is None else full_col
    d = df.withColumns({"_direct": F.try_parse_json(F.col(json_col)), "_fixed_txt": repaired_text(F.col(full))})
    d = d.withColumn("_fixed", F.try_parse_json(F.col("_fixed_txt")))
    direct_ok = F.col("_direct").isNotNull()
    status = (
        F.when(direct_ok, F.lit(STATUS_VALID))
        .when(F.col("_fixed").isNotNull() & _is_object_text(F.col("_fixed_txt")), F.lit(STATUS_REPAIRED))
        .otherwise(F.lit(STATUS_NONE))
    )
    d = d.withColumn("status", status)
    answer = F.when(F.col("status") == STATUS_VALID, F.col("_direct")).when(F.col("status") == STATUS_REPAIRED, F.col("_fixed"))
    responded = (F.col("status") == STATUS_REPAIRED) | (direct_ok & _is_object_text(F.col(json_col)))
    d = d.withColumn("responded", F.coalesce(responded, F.lit(False)))
    return d.withColumn("answer", answer).drop("_direct", "_fixed_txt", "_fixed")
