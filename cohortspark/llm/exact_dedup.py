"""Exact deduplication as a stateful stream, in DataFrame and SQL functions only.

A Structured Streaming aggregation keeps, per SHA-256 digest and without expiry, the number of
texts, the largest identifier seen and the locator (file, row) of its text, in RocksDB state
stores whose change logs lie in the shared checkpoint folder.  New files only touch the keys
they contain; counts are combined before the shuffle.  The finished state is read as a table.
On every hit the full bytes of a text are then compared with those of the row that stays:
hits meet keepers on (digest, salt) with about ``SALT_ROWS`` rows a key, so that a digest with a
third of all rows is spread out.  Texts that share a digest but differ in bytes are grouped
again by their bytes.

Defined cases: null text counts as empty; null ids sort below all others; among rows with the
same text and id the one at the last locator stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import forget, passing, saved, scratch

#: Hits that one copy of a keeper's text meets.
SALT_ROWS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def digest_of(text: Column, bits: int = 256) -> Column:
    """Lowercase hex SHA-256, cut to ``bits`` (fewer only in tests, to force collisions)."""
    return F.substring(F.sha2(text, 256), 1, bits // 4)


def _locator() -> list[Column]:
    return [F.col("_metadata.file_path").alias("x_file"), F.col("_metadata.row_index").alias("x_row")]


def run_state(
    spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
    bits: int = 256, max_files: int | None = None,
) -> DataFrame:
    """Feed the files of ``path`` that ``checkpoint`` has not seen to the state; return the state.

    One row per digest: x_digest, x_n, x_keep (id, file, row).  Called again after new files
    arrived, it reads only those.
    """
    schema = spark.read.parquet(path).schema
    session = spark.newSession()  # its settings are its own
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # later stages need the memory of the stores
    reader = session.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern, the path may also name a single file, which a file stream refuses otherwise.
    path = path.rstrip("/")
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    keyed = rows.select(
        digest_of(F.coalesce(rows[text_col].cast("string"), F.lit("")), bits).alias("x_digest"),
        F.struct(rows[id_col].alias("id"), *[c.alias(n) for c, n in zip(_locator(), ("file", "row"))]).alias("x_at"),
    )
    state = keyed.groupBy("x_digest").agg(F.count(F.lit(1)).alias("x_n"), F.max("x_at").alias("x_keep"))
    query = (
        state.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    stored = spark.read.format("statestore").load(checkpoint)
    count, keep = stored.schema["value"].dataType.fieldNames()
    return stored.select(
        F.col("key.x_digest").alias("x_digest"), F.col(f"value.{count}").alias("x_n"), F.col(f"value.{keep}").alias("x_keep")
    )


def _judge(spark: SparkSession, path: str, id_col: str, text_col: str, bits: int, max_files: int | None, whole: bool):
    """(rows with their group and, for hits, their text, or if ``whole``, all their columns; checked hits)."""
    with passing(spark):
        state = scratch(spark, "xd-state")
        groups = saved(run_state(spark, path, state, id_col, text_col, bits, max_files), "xd-groups")
        forget(spark, state)
        source = spark.read.parquet(path)
        text = F.coalesce(source[text_col].cast("string"), F.lit(""))
        # A whole row holds its text: it crosses the shuffle once.
        carried = F.struct(*[source[f"`{c}`"] for c in source.columns]).alias("x_source") if whole else text.alias("x_text")
        rows = source.select(source[id_col].alias("x_id"), *_locator(), digest_of(text, bits).alias("x_digest"), carried)
        # Narrow state rows against all rows: AQE splits the partition of a hot digest.
        rows = rows.join(groups, "x_digest")
        is_keeper = (F.col("x_file") == F.col("x_keep.file")) & (F.col("x_row") == F.col("x_keep.row"))
        rows = saved(
            rows.select(
                "x_id", "x_file", "x_row", "x_digest", "x_n", F.col("x_keep.id").alias("x_keep_id"), is_keeper.alias("x_is_keeper"),
                "x_source" if whole else F.when(F.col("x_n") > 1, F.col("x_text")).alias("x_text"),
            ),
            "xd-rows", keep=True,
        )
    text = F.coalesce(F.col("x_source").getField(text_col).cast("string"), F.lit("")) if whole else F.col("x_text")
    hits = rows.filter("x_n > 1").select("x_digest", "x_n", "x_file", "x_row", "x_id", "x_keep_id", "x_is_keeper", text.alias("x_text"))
    salts = F.floor((F.col("x_n") - 1) / SALT_ROWS)
    keepers = hits.filter("x_is_keeper").select(
        "x_digest", F.col("x_text").alias("x_kept_text"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts)).alias("x_salt")
    )
    checked = hits.withColumn("x_salt", F.pmod(F.xxhash64("x_file", "x_row"), salts + 1)).join(keepers, ["x_digest", "x_salt"])
    same = F.col("x_text") == F.col("x_kept_text")
    checked = saved(
        checked.select(
            "x_digest", "x_salt", "x_n", "x_file", "x_row", "x_id", "x_keep_id", "x_is_keeper", same.alias("x_same"),
            F.when(~same, F.col("x_text")).alias("x_text"),
        ),
        "xd-checked",
    )
    return rows, checked


def _strays(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose bytes differ from their digest's keeper, grouped by bytes; how many a digest has, for every salt."""
    odd = checked.filter("NOT x_same")
    at = F.struct("x_id", "x_file", "x_row")
    groups = odd.groupBy("x_digest", "x_text").agg(F.count(F.lit(1)).alias("x_own_n"), F.max(at).alias("x_own"))
    strays = odd.join(groups, ["x_digest", "x_text"])
    counts = odd.groupBy("x_digest").agg(F.count(F.lit(1)).alias("x_odd"), F.first("x_n").alias("x_of"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("x_of") - 1) / SALT_ROWS))
    return strays, counts.select("x_digest", "x_odd", F.explode(salts).alias("x_salt"))


def dedup_table(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    bits: int = 256, max_files: int | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, digest."""
    rows, checked = _judge(spark, path, id_col, text_col, bits, max_files, whole=False)
    strays, odd = _strays(checked)
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    single = rows.filter("x_n = 1").select("x_id", "x_id", "x_n", F.lit(True), "x_digest").toDF(*out)
    same = checked.filter("x_same").join(odd, ["x_digest", "x_salt"], "left").select(
        "x_id", "x_keep_id", F.col("x_n") - F.coalesce("x_odd", F.lit(0)), "x_is_keeper", "x_digest"
    ).toDF(*out)
    own = strays.select(
        "x_id", F.col("x_own.x_id"), "x_own_n",
        (F.col("x_own.x_file") == F.col("x_file")) & (F.col("x_own.x_row") == F.col("x_row")), "x_digest",
    ).toDF(*out)
    return single.union(same).union(own)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256, max_files: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``docs`` is written to the shared folder first: a stream needs files, and they give
    every row a fixed locator whatever plan made it.
    """
    spark = docs.sparkSession
    path = scratch(spark, "xd-docs")
    docs.write.parquet(path)
    rows, checked = _judge(spark, path, id_col, text_col, bits, max_files, whole=True)
    forget(spark, path)
    strays, _ = _strays(checked)
    own = strays.filter("x_own.x_file = x_file AND x_own.x_row = x_row").select("x_file", "x_row")
    hits = rows.filter("x_n > 1")  # strays share their digest with another row
    stay = rows.filter("x_n = 1 OR x_is_keeper").unionByName(hits.join(own, ["x_file", "x_row"], "left_semi").select(*rows.columns))
    return stay.select("x_source.*")
