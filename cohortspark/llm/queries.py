"""The registered queries of the numbered operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import crc_bucket, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.wrapper import extract

    rows = extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.quality import COUNTS, quality_filter

    rows = quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "probability")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.bpe import encode

    rows = encode(table(spark, sf_dir, "documents"), with_decoded=True)
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.exact_dedup import dedup_table

    return dedup_table(spark, f"{sf_dir.rstrip('/')}/documents.parquet").withColumnRenamed("digest", "text_sha256")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.substring import dedup_substrings

    rows = dedup_substrings(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("n_removed") > 0, F.sha2(F.col("kept_text"), 256)).otherwise(F.col("sha256"))
    return rows.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.langid import fit_centroids, held_out, identify

    docs = table(spark, sf_dir, "documents")
    unseen = held_out(crc_bucket(F.col("doc_id"), 4))
    rows = identify(docs.select("doc_id", "text"), fit_centroids(docs.filter(~unseen)))
    return rows.select("doc_id", unseen.alias("held_out"), "lang_pred", "score", "rejected")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.merkle import tamper_audit

    return tamper_audit(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortspark.llm.suffixes import dedup_bytes

    return dedup_bytes(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_html, op3_quality, op4_bpe, op5_exact_dedup, op6_lm_score, op7_near_dedup, op8_sharding, op9_substring_dedup, op10_language,
    op11_merkle_manifest, op12_filter_audit, op13_suffix_array,
)}

ORACLES = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    # crc32 bit by bit over the id's digits; node levels and folds as recursive tables.
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) % 2) = 1 AS hit,
                   concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
                     coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-')) AS head,
                   text, replace(text, chr(10), '') AS cut FROM documents),
        l AS (SELECT doc_id, source, sha256(head || coalesce(concat(strlen(text), ':', text), '-')) AS leaf,
                     sha256(head || CASE WHEN hit THEN coalesce(concat(strlen(cut), ':', cut), '-') ELSE coalesce(concat(strlen(text), ':', text), '-') END) AS new FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM documents)),
        x AS (SELECT p.*, s.tree, s.trees FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source),
        low AS (SELECT 0 AS level, tree, pos, n, leaf AS h FROM x
                UNION ALL SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, tree, pos // 3, n),
        sub AS (SELECT tree, h FROM low WHERE n = 1),
        high AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM sub) AS n, h FROM sub
                 UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
        runs AS (SELECT level, tree, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY level, tree, pos // 3),
        tops AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM high WHERE n > 1 GROUP BY level, pos // 3),
        up AS (SELECT doc_id, leaf, tree, 0 AS level, pos, n, new AS h, '' AS proof FROM x
               UNION ALL SELECT doc_id, leaf, up.tree, up.level + 1, pos // 3, (n + 2) // 3,
                 sha256(array_to_string(list_concat(list_concat(hs[1:pos % 3], [h]), hs[pos % 3 + 2:]), '')),
                 proof || array_to_string(list_concat(hs[1:pos % 3], hs[pos % 3 + 2:]), '')
               FROM up JOIN runs ON runs.level = up.level AND runs.tree = up.tree AND runs.run = up.pos // 3 WHERE n > 1),
        top AS (SELECT doc_id, leaf, tree, 0 AS level, tree AS pos, (SELECT count(*) FROM sub) AS n, h, proof FROM up WHERE n = 1
                UNION ALL SELECT doc_id, leaf, tree, top.level + 1, pos // 3, (n + 2) // 3,
                  sha256(array_to_string(list_concat(list_concat(hs[1:pos % 3], [h]), hs[pos % 3 + 2:]), '')),
                  proof || array_to_string(list_concat(hs[1:pos % 3], hs[pos % 3 + 2:]), '')
                FROM top JOIN tops ON tops.level = top.level AND tops.run = top.pos // 3 WHERE n > 1)
        SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, top.h AS folded_root, top.h = root.h AS verified
        FROM top JOIN sub ON sub.tree = top.tree, (SELECT h FROM high WHERE n = 1) root WHERE top.n = 1""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first < w.doc_id, false)} AS x
              FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
        cells AS (SELECT part, [x.A, x.B, x.C, x.D, x.E] AS x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e
                   WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        steps AS (SELECT o, l.i AS step, o[l.i] AS k, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order FROM orders, l),
        g AS (SELECT part, filter_order, step, k, n, good, toxic, x[k] AS hit,
                len(list_filter(o[1:step - 1], lambda i: x[i])) > 0 AS before, len(list_filter(x, lambda v: v)) AS fails FROM cells, steps),
        r AS (SELECT part, filter_order, step, k,
                coalesce(sum(n) FILTER (NOT hit AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT before), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (hit AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND fails = 1), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (hit AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT before), 0)::BIGINT AS toxic_lost
              FROM g GROUP BY part, filter_order, step, k)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r""",
}
