"""Canonical report view over the driver's test tables.

The test tables hold invented prose; this view gives them the shape of a
report archive (patients, visits, four report slots, labels, demographics) so
every operator has non-trivial input.  The same view is written once more as a
SQL CTE for the DuckDB oracle (``cohortspark.plans.oracle.REPORTS_CTE``).

Long form, one row per document:
``doc_id, study_id, visit_id, report_col, ord, text, gold, gold_alt, gender,
ethnicity_raw, age, imd, split, split_leaky``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Report slots in slot order (doc_id % 4).
REPORT_SLOTS = ["pathology", "endoscopy", "letter_before", "letter_after"]

# Raw ethnicity per source number % 6: four known spellings, one unknown, one missing.
RAW_ETHNICITY = ["White British", "Indian", "Caribbean", "Mixed White and Asian", "unrecorded", None]

DOCS_PER_PATIENT = 12
VALIDATION_EVERY = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _slot_expr(col):
    e = None
    for i, name in enumerate(REPORT_SLOTS):
        e = (F.when(col == i, F.lit(name))) if e is None else e.when(col == i, F.lit(name))
    return e


def _ethnicity_expr(source):
    num = F.regexp_extract(source, r"(\d+)$", 1).cast("int") % len(RAW_ETHNICITY)
    e = None
    for i, raw in enumerate(RAW_ETHNICITY):
        v = F.lit(raw).cast("string")
        e = F.when(num == i, v) if e is None else e.when(num == i, v)
    return e


def report_view(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    d = docs.alias("d").join(labels.alias("l"), on="doc_id", how="left")
    doc_id = F.col("doc_id")
    study = F.floor(doc_id / DOCS_PER_PATIENT).cast("long")
    cols = [
        doc_id.alias("doc_id"),
        study.alias("study_id"),
        (F.floor(doc_id / 4).cast("long") % 3).alias("visit_id"),
        _slot_expr(doc_id % 4).alias("report_col"),
        doc_id.alias("ord"),
    ]
    if with_text:
        cols.append(F.when(doc_id % 17 != 0, F.col("d.text")).alias("text"))
    cols += [
        F.col("l.quality").cast("int").alias("gold"),
        F.col("l.toxic").cast("int").alias("gold_alt"),
        F.col("d.lang").alias("gender"),
        _ethnicity_expr(F.col("d.source")).alias("ethnicity_raw"),
        (F.col("d.n_chars") % 110).alias("age"),
        (study % 12).alias("imd"),
        F.when(study % VALIDATION_EVERY == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split"),
        F.when(doc_id % VALIDATION_EVERY == 0, F.lit("validation")).otherwise(F.lit("train")).alias("split_leaky"),
    ]
    return d.select(*cols)


def text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) straight from ``documents`` with the view's null-text rule.

    Text work (flags, phrases, models) runs on this narrow side; its results are
    joined to the label/demographic view by ``doc_id`` afterwards, so the text
    column itself never crosses a shuffle for the label join.
    """
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("text"))


def concept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept rows built from ``part``: concept id, language, kind, string, file order.

    ``p_partkey % 500`` is the concept, ``p_name`` its string, ``p_type`` picks the
    term kind (PT for ECONOMY/STANDARD/PROMO, SY otherwise), ``p_size`` > 45 marks
    a non-English row, ``p_partkey`` % 3 / % 2 vary term status and preferred flag.
    """
    part = table(spark, sf_dir, "part")
    return part.select(
        F.format_string("C%07d", F.col("p_partkey") % 500).alias("CUI"),
        F.when(F.col("p_size") > 45, F.lit("FRE")).otherwise(F.lit("ENG")).alias("LAT"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("S")).otherwise(F.lit("P")).alias("TS"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("ISPREF"),
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO"), F.lit("PT")).otherwise(F.lit("SY")).alias("TTY"),
        F.col("p_name").alias("STR"),
        F.col("p_partkey").alias("ord"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers built from ``events``: (study_id, procedure_date, json_response, full_response, ord).

    ``props`` holds ``{"k": n}``; by ``event_id % 5`` it is kept, given a trailing
    comma, wrapped in prose, given a ``//`` comment, or truncated.  Error events
    of the first kind answer with a bare number (valid JSON, not an object).
    """
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    p = F.col("props")
    damaged = (
        F.when((k == 0) & (F.col("event_type") == "error"), F.lit("42"))
        .when(k == 0, p)
        .when(k == 1, F.regexp_replace(p, r"\}$", ",}"))
        .when(k == 2, F.concat(F.lit("Answer: "), p, F.lit(" (end)")))
        .when(k == 3, F.regexp_replace(p, r"\}$", " // checked\n}"))
        .otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    )
    return ev.select(
        F.col("user_id").alias("study_id"),
        F.to_date("ts").alias("procedure_date"),
        damaged.alias("json_response"),
        damaged.alias("full_response"),
        F.col("event_id").alias("ord"),
    )


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human-validated rows built from ``orders`` in the key space of ``answers``:
    study_id = o_custkey % 150, endoscopy_date = 2024-01-01 + (o_orderkey % 30) days,
    gold = (o_orderstatus = 'F'), ord = o_orderkey; (study_id, date) repeats."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 150).alias("study_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("endoscopy_date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("gold"),
        F.col("o_orderkey").alias("ord"),
    )


def patient_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographics of a study id by joins customer -> nation -> region: (study_id, segment, region)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .join(r, n.n_regionkey == r.r_regionkey, "left")
        .select(F.col("c_custkey").alias("study_id"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    )


VEC_BUCKETS = 500


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors: distinct lower-cased tokens of ``benchmark`` texts, each paired with the
    ``embeddings`` row ``vec_id = (ascii(word) * 7 + length(word) * 13) % 500``."""
    from cohortspark.functions import text as tx

    b = table(spark, sf_dir, "benchmark")
    words = b.select(F.explode(tx.tokens("text", tx.TOKEN_ANY)).alias("word")).distinct()
    words = words.withColumn("vec_id", ((F.ascii("word") * 7 + F.length("word") * 13) % VEC_BUCKETS).cast("long"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return words.join(e, on="vec_id", how="inner").select("word", "vector")


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, token, score): document tokens cut into pieces of 4 characters, pieces after
    the first marked ``##``; pos = token position * 1000 + piece index; score from the piece text."""
    from cohortspark.functions import text as tx

    # Texts are dealt by document before their pieces are made: sweeps over a document's pieces then move nothing.
    # The number is given, since partitions joined by the size of the texts would be too large for the pieces.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").repartition(parts, "doc")
    d = dealt.select("doc", tx.tokens("text", tx.TOKEN_ANY).alias("_t"))
    t = d.select("doc", F.posexplode("_t").alias("tpos", "tok"))
    n = F.expr("cast(ceil(length(tok) / 4.0) as int)")
    t = t.select("doc", "tpos", "tok", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("j", "_j"))
    piece = F.expr("substring(tok, j * 4 + 1, 4)")
    return t.select(
        "doc",
        (F.col("tpos") * 1000 + F.col("j")).alias("pos"),
        F.when(F.col("j") == 0, piece).otherwise(F.concat(F.lit("##"), piece)).alias("token"),
        ((F.ascii(piece) % 11 - 5) / 4.0).alias("score"),
    )
