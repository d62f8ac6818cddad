"""Default vocabularies and lookup tables.

Operators take these as DataFrames so that users can pass their own; the
functions here only turn the defaults into small DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------- #
# FIXED VALUES — must equal the original tool's tables for identical results. #
# --------------------------------------------------------------------------- #

# Raw ethnicity (compared lower-cased) -> reported group.  Null or unknown -> "Not Asked".
ETHNICITY_GROUPS = [
    ("white british", "White"),
    ("white other", "White"),
    ("white irish", "White"),
    ("indian", "Asian"),
    ("pakistani", "Asian"),
    ("bangladeshi", "Asian"),
    ("chinese", "Asian"),
    ("asian other", "Asian"),
    ("african", "African"),
    ("black other", "African"),
    ("caribbean", "African"),
    ("mixed white and asian", "Asian"),
    ("mixed white and black african", "African"),
    ("mixed white and black caribbean", "African"),
    ("ethnic other", "Not Asked"),
    ("mixed other", "Not Asked"),
    ("not asked", "Not Asked"),
    ("not stated", "Not Asked"),
]
ETHNICITY_DEFAULT = "Not Asked"

# Reference (comparison) group per protected attribute.
REFERENCE_GROUPS = [
    ("age_group", "20-30"),
    ("gender", "F"),
    ("ethnicity", "Black"),
    ("imd_group", "1-2"),
]

# Protected attributes evaluated by default.
DEMOGRAPHIC_ATTRS = ["gender", "ethnicity", "imd_group", "age_group"]

# Negation cue phrases by kind.
NEGATION_TERMS = [
    ("pseudo", "without"),
    ("pseudo", "no"),
    ("pseudo", "negative for"),
    ("pseudo", "rule out"),
    ("pseudo", "exclude"),
    ("pseudo", "absence of"),
    ("preceding", "not"),
    ("preceding", "no evidence of"),
    ("preceding", "without"),
    ("following", "no evidence of"),
    ("following", "no signs of"),
    ("following", "no history of"),
    ("following", "no indication of"),
]
# Scope terminators (also sentence ends).
NEGATION_TERMINATORS = [";", "."]

# IMD deciles -> quintile labels; the first bin also takes 0: [0,2], (2,4], ..., (8,10].
IMD_BINS = [(0, 2, "1-2"), (2, 4, "3-4"), (4, 6, "5-6"), (6, 8, "7-8"), (8, 10, "9-10")]

# Age decades [lo, lo+10) for lo = 0, 10, ..., 90.
AGE_BIN_WIDTH = 10
AGE_MAX = 100

# LLM answer fields.
RESPONSE_FIELDS = {
    "title": "Title",
    "features": "Features",
    "likelihood": "Likelihood of IBD",
    "certainty": "Certainty Level",
    "complexity": "Complexity of Case",
}
LIKELIHOOD_THRESHOLD = 5.0

# Grid of the document classifiers: max document share x n-gram range x penalty x C.
GRID_MAX_DF = [0.75, 1.0]
GRID_NGRAMS = [1, 2]
GRID_PENALTY = ["l1", "l2"]
GRID_C = [0.01, 0.1, 1.0, 10.0]
CV_FOLDS = 5
BOOTSTRAP_REPLICATES = 1000

# --------------------------------------------------------------------------- #


def ethnicity_map_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ETHNICITY_GROUPS, "raw string, grp string")


def reference_groups_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE_GROUPS, "attribute string, ref_group string")


def negation_terms_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NEGATION_TERMS, "kind string, phrase string")
