"""ReportSchema: the configuration that names the columns of a report table.

Wide form (one row per visit): an id, several report text columns, one 0/1 gold
label per text column, a patient label and demographics.  Long form (preferred
inside the library): ``study_id, visit_id, report_col, ord, text, gold, ...``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReportSchema:
    id_col: str = "study_id"
    order_col: str | None = None
    text_labels: dict = field(
        default_factory=lambda: {
            "histopathology_report": "Histopath_IBD",
            "endoscopy_report": "Endoscopy_IBD",
            "preceding_clinic_letter": "Preceding_Clinic_IBD",
            "following_clinic_letter": "Following_Clinic_IBD",
        }
    )
    patient_label: str = "Patient_Has_IBD"
    demographics: tuple = ("cohort", "age", "gender", "ethnicity", "imd")
    drop: tuple = ("IBD_Prediction",)
    combined_text: str = "combined_text"

    @property
    def text_cols(self) -> list[str]:
        return list(self.text_labels)

    @property
    def label_cols(self) -> list[str]:
        return list(self.text_labels.values())


def wide_to_long(df: DataFrame, schema: ReportSchema, keep: list[str] | None = None) -> DataFrame:
    """Unpivot the text/label pairs of a wide table into one row per (visit, report column)."""
    keep = [c for c in (keep or []) if c in df.columns]
    pairs = [(t, l) for t, l in schema.text_labels.items() if t in df.columns]
    entries = [
        F.struct(
            F.lit(t).alias("report_col"),
            F.col(t).cast("string").alias("text"),
            (F.col(l).cast("int") if l in df.columns else F.lit(None).cast("int")).alias("gold"),
        )
        for t, l in pairs
    ]
    return df.select(schema.id_col, *keep, F.explode(F.array(*entries)).alias("r")).select(
        schema.id_col, *keep, "r.report_col", "r.text", "r.gold"
    )
