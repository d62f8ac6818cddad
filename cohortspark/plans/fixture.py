"""Parameters of the registered queries over the driver's test tables.

The test prose has no clinical words, so the vocabularies below use words that
do occur in it (measured document frequencies in FIXTURES.md).  They are
parameters handed to the operators exactly as a user's vocabulary would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keyword categories for the regex and phrase cohorts: (category, pattern).
VOCAB = [("A", "thre"), ("A", "eron"), ("B", "license"), ("B", "apache")]
# Multi-word phrases for phrase matching: (category, phrase).
PHRASES = [("A", "thre"), ("A", "eron"), ("B", "license"), ("B", "apache"), ("B", "mit license"), ("B", "apache license")]
# Negation cues for the fixture: ordinary words act as cues.
CUES = [("pseudo", "or the"), ("preceding", "the"), ("preceding", "and"), ("following", "or")]

LABEL = "gold_alt"  # toxic: a rare class at document and patient level
DEMOGRAPHICS = ["gender", "ethnicity", "imd_group", "age_group"]
REFERENCE = [("gender", "fr"), ("ethnicity", "Black"), ("imd_group", "1-2"), ("age_group", "20-30")]

# Terms for concept lookup (strings of the part-derived concept rows).
CONCEPT_TERMS = ["red widget", "Blue Bolt", "small ring", "no such thing"]
CONCEPT_PATTERNS_A = ["widget"]
CONCEPT_PATTERNS_B = ["^blue"]


def vocab_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCAB, "category string, pattern string")


def phrases_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHRASES, "category string, phrase string")


def cues_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CUES, "kind string, phrase string")


def reference_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE, "attribute string, ref_group string")

# Term standardisation table for the documents: (alias, preferred, ord); overlapping on purpose.
STANDARD_TERMS = [
    ("mit license", "MIT License", 1),
    ("license", "licence", 2),
    ("apache license", "Apache License", 3),
    ("thre", "three", 4),
    ("eron", "Eron", 5),
    ("the thre", "THE-THREE", 6),
]


def standard_terms_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STANDARD_TERMS, "alias string, preferred string, ord long")
