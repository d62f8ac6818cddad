"""Text and vector features in long form (ops 72, 73, 75, 80).

Feature tables are long: ``(doc, term, tf[, weight])``.  Tokens and n-grams are
made row-locally with array functions; term statistics are partial aggregates;
document norms are one aggregate + equi-join.  No vocabulary is collected to
the driver, so the vocabulary size is not bounded by driver memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import text as tx
from cohortspark.operators.joins import bounded_broadcast
from cohortspark.session import cut_lineage

#: A table of word vectors of at most so many numbers (20 MB) is sent to all tasks.
VECTOR_NUMBERS = 2_500_000


def ngram_array(tokens: Column, n: int) -> Column:
    """Array of n-grams (tokens joined by one space) from a token array (row-local)."""
    if n == 1:
        return tokens

    def make(i):
        return F.struct(i.alias("i"), F.array_join(F.slice(tokens, i, n), " ").alias("g"))

    def complete(x):
        return x["i"] + n - 1 <= F.size(tokens)

    # sequence(1, m) counts down when m < 1: clamp, then drop incomplete grams
    grams = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), make), complete)
    return F.transform(grams, lambda x: x["g"])


def scalar(df: DataFrame, col: str) -> Column:
    """A one-row, one-column aggregate as a scalar subquery (no join; computed once, inlined)."""
    return df.select(col).scalar()


def _unique(df: DataFrame, id_col: str) -> bool:
    return df.groupBy(id_col).count().filter("count > 1").isEmpty()


def _slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, size = batch.num_rows, batch.column(batch.num_columns - 1).nbytes
        step = max(1, n * max_bytes // max(size, 1))
        yield from (batch.slice(at, step) for at in range(0, n, step))


def count_terms(batches: Iterator[pa.RecordBatch], ngram_max: int) -> Iterator[pa.RecordBatch]:
    """Rows of (columns to keep, tokens) -> rows of (columns to keep, term, tf), for every row by itself.

    Tokens are numbered within some MB of them, n-grams are pairs of the shorter gram's number and a token's; text is made of the distinct ones alone.
    """
    for batch in _slices(batches):
        tokens = batch.column(batch.num_columns - 1)
        offsets = tokens.offsets.to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        coded = tokens.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        at, grams, names = np.arange(len(codes)), codes, words
        for n in range(1, ngram_max + 1):
            if n > 1:
                follows = at + n - 1 < len(codes)
                at, grams = at[follows], grams[follows]
                follows = owner[at] == owner[at + n - 1]
                at, grams = at[follows], grams[follows]
                pairs, grams = np.unique(grams * len(words) + codes[at + n - 1], return_inverse=True)
                names = pc.binary_join_element_wise(names.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))), " ")
            if not len(at):
                break
            found, counts = np.unique(owner[at] * len(names) + grams, return_counts=True)
            kept = [batch.column(i).take(pa.array(found // len(names))) for i in range(batch.num_columns - 1)]
            terms = names.take(pa.array(found % len(names)))
            yield pa.RecordBatch.from_arrays([*kept, terms, pa.array(counts.astype(np.int64))], names=[*batch.schema.names[:-1], "term", "tf"])


# op 72
def bow_features(
    df: DataFrame, id_col: str, text_col: str, ngram_max: int = 1, max_df: float = 1.0, dealt: bool = False, also: Sequence[str] = (),
) -> DataFrame:
    """(id, also, term, tf): lower-cased tokens of >= 2 word characters, uni- up to ``ngram_max``-grams.

    ``max_df`` (a share of documents) drops terms present in more documents.  ``dealt``: ``df`` lies by id already (a join on it).
    ``also``: columns that depend on the id.  Where no id comes twice (a look at the ids alone) rows are counted where they are.
    """
    toks = tx.tokens(text_col, tx.TOKEN_2PLUS)
    own = [id_col, *also]
    if _unique(df, id_col):
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), "term string, tf bigint"])
        tf = df.select(*own, toks.alias("_tok")).mapInArrow(lambda batches: count_terms(batches, ngram_max), schema)
    else:
        arrays = [ngram_array(F.col("_tok"), n) for n in range(1, ngram_max + 1)]
        allt = F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]
        # Texts are dealt by id before their tokens and grams are made: counts, and joins and sums by id after them, then move nothing.
        # The number is given, since partitions joined by the size of the texts would be too large for the grams.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = df.select(*own, text_col) if dealt else df.select(*own, text_col).repartition(parts, id_col)
        t = texts.select(*own, toks.alias("_tok")).select(*own, F.explode(allt).alias("term"))
        tf = t.groupBy(*own, "term").agg(F.count(F.lit(1)).alias("tf"))
    if max_df < 1.0:
        n_docs = scalar(df.agg(F.count(F.lit(1)).alias("_n")), "_n")
        dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        common = dfreq.filter(F.col("_df") > F.lit(max_df) * n_docs).select("term")
        # No more than a document's mean number of terms over ``max_df``: the counts stay where they are.
        tf = tf.join(F.broadcast(common) if max_df >= 0.01 else common, on="term", how="left_anti").select(*tf.columns)
    return tf


# op 73
def tfidf_features(tf: DataFrame, id_col: str, n_docs: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, weight): tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per document.

    ``n_docs`` is a one-row DataFrame with column ``n`` (documents fitted); by
    default the number of distinct ids in ``tf``.
    """
    if n_docs is None:
        n_docs = tf.agg(F.countDistinct(id_col).alias("n"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    n = scalar(n_docs.select(F.col("n").cast("double").alias("_n")), "_n")
    idf = dfreq.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("_df"))) + F.lit(1.0)).alias("_idf"))
    w = tf.join(idf, on="term", how="inner").withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return w.filter(F.col(id_col).isNotNull()).select(id_col, "term", "tf", (F.col("_w") / norm).alias("weight"))  # a null id is no document


# op 75
def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, partitions: int | None = None) -> DataFrame:
    """fold = (rank of the row inside its class, by id) mod k: every fold keeps the class ratio.

    The rank is computed without a single-task window: rows are range-partitioned
    by (label, id), each partition numbers its rows locally, and a tiny table of
    per-partition class counts gives the offsets.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    # Partition numbers are fixed once, on the two columns alone: planned again they could differ.
    keys = df.select(F.col(label_col).alias("_label"), F.col(id_col).alias("_id"))
    r = cut_lineage(keys.repartitionByRange(n, "_label", "_id").withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", "_label").orderBy("_id")
    r = r.withColumn("_rn", F.row_number().over(local) - 1)
    counts = r.groupBy("_pid", "_label").agg(F.count(F.lit(1)).alias("_c"))
    prev = Window.partitionBy("_label").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(prev), F.lit(0))).select(F.col("_pid").alias("_p"), F.col("_label").alias("_l"), "_off")
    same = (F.col("_pid") == F.col("_p")) & F.col("_label").eqNullSafe(F.col("_l"))
    folds = r.join(F.broadcast(offs), same)  # partitions x classes rows
    folds = folds.select("_id", ((F.col("_off") + F.col("_rn")) % k).cast("int").alias("fold"))
    return df.join(folds, df[id_col].eqNullSafe(folds["_id"]), "left").drop("_id")  # ids are unique


# op 80
def mean_word_vectors(
    df: DataFrame, id_col: str, text_col: str, vectors: DataFrame, dim: int, word_col: str = "word", vec_col: str = "vector",
) -> DataFrame:
    """Long (id, dim, value): ``mean_vectors`` by dimension."""
    rows = mean_vectors(df, id_col, text_col, vectors, dim, word_col, vec_col)
    return rows.select(id_col, F.posexplode("vector").alias("dim", "value"))


def mean_vectors(
    df: DataFrame, id_col: str, text_col: str, vectors: DataFrame, dim: int, word_col: str = "word", vec_col: str = "vector",
) -> DataFrame:
    """(id, vector): mean over ALL tokens of the word vectors, unknown tokens as zeros.

    A document without known tokens gets zeros.  Documents are dealt by id once; a document's tokens are counted
    per word there, meet the word vectors where they are (a table of up to ``VECTOR_NUMBERS`` numbers is sent
    to all tasks; a larger one is met by an equi-join on the word), and whole vectors are summed with the counts
    as weights; the mean divides by the document's token count.
    """
    dealt = df.select(id_col, text_col).repartition(id_col)  # one shuffle, of texts, for both sides below
    toks = dealt.select(id_col, tx.tokens(text_col, tx.TOKEN_ANY).alias("_t"))
    ntok = toks.select(id_col, F.size("_t").alias("_ntok"))
    words = toks.select(id_col, F.explode("_t").alias(word_col)).groupBy(id_col, word_col).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    table = bounded_broadcast(vectors.filter(F.col(vec_col).isNotNull()).select(word_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v")), VECTOR_NUMBERS // max(dim, 1))
    known = words.join(table, on=word_col, how="inner")
    sums = known.groupBy(id_col).agg(Summarizer.sum(F.col("_v"), F.col("_n")).alias("_s"))
    out = ntok.join(sums.select(id_col, vector_to_array("_s").alias("_s")), on=id_col, how="left")
    mean = F.transform("_s", lambda v: v / F.col("_ntok"))
    return out.select(id_col, F.coalesce(mean, F.array_repeat(F.lit(0.0), dim)).alias("vector"))
