"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian verification.

Documents become sets of word shingles (64-bit hashes).  Equal sets collapse to the one with the
smallest id first.  Signatures are cut into bands; documents that share a band are candidates.
A candidate pair's signatures are compared batch by batch; after n values with m matches under a
uniform prior, the pair is dropped once P(similarity >= threshold | m, n) falls below ``miss``.
Survivors are verified on their full sets.

No bucket is expanded into all pairs.  Its members meet one hub first, the member with the most
shared bands; the links found join documents into components.  Of the buckets that still hold
several components, pairs across components are taken that also share a rare shingle, which
every linked pair must: no link is lost, none inside a component is sought.

Defined cases: null or empty texts have empty sets and link with nothing; rows that repeat an id
are one document; rows without an id are never linked, have no component and stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import WordHashes, in_slices, mix64, passing, saved, window_hashes, words_of
from cohortspark.llm.components import components

#: A pair at similarity 0.8 shares no band with a chance of (1 - 0.8^4)^32, below 1e-7.
BANDS, ROWS, BATCH = 32, 4, 32
#: Bits of the filter of ids with candidates: one for about every document up to 67 million.
FILTER_BITS = 1 << 26
_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    return np.unique(window_hashes(hashes, min(n, k)) + np.uint64(0 if n >= k else n))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, ((part[None, :] * _FACTORS[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low


def least_matches(threshold: float, miss: float, sizes: tuple = tuple(range(BATCH, BANDS * ROWS + 1, BATCH))) -> dict[int, int]:
    """For each number n of compared values, the fewest matches that keep a pair.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its mass above the threshold is
    the chance of at most m successes in n + 1 draws.
    """
    out = {}
    for n in sizes:
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingled(docs: DataFrame, id_col: str, text_col: str, k: int, with_set: bool) -> DataFrame:
    """doc_id, n, digest of the set, and either the set itself or signature and band keys."""
    band_salt = mix64(np.arange(100, 100 + BANDS, dtype=np.uint64))

    def run(batches: Iterator) -> Iterator:
        import xxhash

        known = WordHashes(limit=200_000)
        for batch in in_slices(batches, max_bytes=2 << 20):  # the sets of a slice are all held
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                s = shingle_set(known.of(words_of(text, lower=True)), k)
                raw = s.tobytes()
                if with_set:
                    out.append((doc_id, len(s), raw))
                    continue
                sig = signature(s)
                keys = mix64(window_hashes(sig.astype(np.uint64), ROWS)[::ROWS] ^ band_salt).view(np.int64)
                out.append((doc_id, len(s), xxhash.xxh3_128_digest(raw), sig.tobytes(), keys if len(s) else keys[:0]))
            for at in range(0, len(out), 1000):
                columns = list(zip(*out[at : at + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    if with_set:
        names, kinds, schema = ["doc_id", "n", "set"], [pa.int64(), pa.int64(), pa.binary()], "doc_id bigint, n bigint, set binary"
    else:
        names = ["doc_id", "n", "digest", "signature", "bands"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        schema = "doc_id bigint, n bigint, digest binary, signature binary, bands array<bigint>"
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def likely(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id may be one of ``ids`` (doc_id), by one bit of a hash: every row of theirs, and few others.

    The bitmap has ``FILTER_BITS`` bits, 8 MB whatever the number of ids, so it is broadcast; the
    more ids, the more other rows stay, which a join after it drops.
    """
    page = 32_768  # bits of one bitmap of bitmap_construct_agg
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    pages = ids.select(place(F.col("doc_id")).alias("x_at")).groupBy(F.floor(F.col("x_at") / page).alias("x_page"))
    pages = pages.agg(F.bitmap_construct_agg(F.col("x_at") % page).alias("x_bits"))
    at = place(F.col(id_col)) % page
    byte = F.conv(F.hex(F.substring("x_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(pages), F.floor(place(F.col(id_col)) / page) == F.col("x_page"))
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def verified(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    least = least_matches(percent / 100, miss)

    @F.pandas_udf("boolean")
    def plausible(one: pd.Series, two: pd.Series) -> pd.Series:
        width = BANDS * ROWS
        same = np.frombuffer(b"".join(one), np.uint32).reshape(-1, width) == np.frombuffer(b"".join(two), np.uint32).reshape(-1, width)
        alive, matches = np.arange(len(same)), np.zeros(len(same), np.int64)
        for n, m in least.items():  # batch by batch, over the pairs still alive
            matches[alive] += same[alive, n - BATCH : n].sum(axis=1)
            alive = alive[matches[alive] >= m]
        out = np.zeros(len(same), bool)
        out[alive] = True
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def similar(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(one, two):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    side = lambda df, key, column: df.select(F.col("doc_id").alias(key), F.col(column).alias(f"{column}_{key}"))
    left = pairs.join(side(signatures, "a", "signature"), "a").join(side(signatures, "b", "signature"), "b")
    left = saved(left.filter(plausible("signature_a", "signature_b")).select("a", "b").distinct(), "mh-plausible")
    full = left.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b")
    return saved(full.filter(similar("set_a", "set_b")).select("a", "b").distinct(), "mh-links")


def across(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of different components that share a band and may reach the threshold.

    Two sets that do must share one of their rarest n - ceil(percent * n) + 1 shingles, counted
    among these documents, and early enough in both for the overlap that the threshold asks:
    a passage that thousands hold brings no pair together.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = part.column(1).to_pylist()
                ids = np.repeat(part.column(0).to_numpy(), [len(r) // 8 for r in raw])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["doc_id", "shingle"])

    rows = sets.join(apart.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "set")
    rows = saved(rows.mapInArrow(run, "doc_id bigint, shingle bigint"), "mh-shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Shingles of one document come first in its order and bring no pair: only their number counts.
    own = rows.join(often, "shingle").join(apart, "doc_id")
    held = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "shingle")) + F.col("n") - held
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    own = own.withColumn("nth", nth).filter(F.col("nth") <= prefix).select("shingle", "doc_id", "n", "component", "bands", "nth")
    own = saved(own, "mh-prefix")
    other = own.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "n", "component", "bands", "nth")])
    close = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent
    meets = (F.col("doc_id") < F.col("other_doc_id")) & (F.col("component") != F.col("other_component")) & close & F.arrays_overlap("bands", "other_bands")
    # The first shared shingle leaves room for at most that many shared ones.
    room = (1 + F.least(F.col("n") - F.col("nth"), F.col("other_n") - F.col("other_nth"))) * (100 + percent)
    meets = meets & (room >= (F.col("n") + F.col("other_n")) * percent)
    pairs = own.join(other, (own["shingle"] == other["shingle"]) & meets)
    return saved(pairs.select(F.col("doc_id").alias("a"), F.col("other_doc_id").alias("b")).distinct(), "mh-across")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-6
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept."""
    with passing(docs.sparkSession):
        rows = saved(shingled(docs, id_col, text_col, shingle, with_set=False), "mh-rows", keep=True)
        sound = rows.filter("doc_id IS NOT NULL")
        # Equal sets: the smallest id stands for all (combined before the shuffle).
        groups = saved(sound.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "mh-groups")
        standing = groups.select(F.col("rep").alias("doc_id")).distinct()
        reps = saved(sound.filter("n > 0").select("doc_id", "n", "bands").join(standing, "doc_id", "left_semi"), "mh-reps")
        members = reps.select(F.explode("bands").alias("key"), "doc_id", "n")
        many = saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low != high"), "mh-buckets")
        members = saved(members.join(many.select("key", "size"), "key"), "mh-members")
        # An original shares bands with all its copies, a copy with fewer: hubs are the best connected.
        degree = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
        members = saved(members.join(degree, "doc_id"), "mh-members")
        close = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
        # Signatures and texts of documents without a candidate are mostly left out before the shuffle.
        wanted = saved(members.select("doc_id").distinct(), "mh-wanted")
        signatures = likely(sound.filter("n > 0").select("doc_id", "signature"), "doc_id", wanted).join(wanted, "doc_id", "left_semi")
        signatures = saved(signatures, "mh-signatures")
        texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        texts = likely(texts, "doc_id", wanted).join(wanted, "doc_id", "left_semi")
        sets = saved(shingled(texts, "doc_id", "text", shingle, with_set=True), "mh-sets")

        def star(of: DataFrame) -> DataFrame:
            """Each member with its bucket's hub."""
            hubs = of.groupBy("key").agg(F.max(F.struct("degree", "doc_id", "n")).alias("hub"))
            hubs = hubs.select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"))
            pairs = of.join(hubs, "key").filter((F.col("doc_id") != F.col("hub")) & close(F.col("n"), F.col("hub_n")))
            return pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()

        links = verified(star(members), signatures, sets, percent, miss)
        labels = components(links)
        # Buckets of two are settled by their one pair; of the others, those with several components are not.
        named = members.filter("size > 2").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        named = saved(named.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "mh-named")
        mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
        apart = saved(named.join(mixed, "key").select("doc_id", "component").distinct(), "mh-apart")
        rest = across(apart.join(reps.select("doc_id", "n", "bands"), "doc_id"), sets, percent)
        labels = components(links.union(verified(rest, signatures, sets, percent, miss)))
        of_group = saved(
            groups.join(labels, groups["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("component")), "mh-classes", keep=True
        )
    # Narrow rows; AQE splits the partition of a hot digest.
    out = rows.select("doc_id", "n", "digest").join(of_group, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are not the smallest id of their component."""
    with passing(docs.sparkSession):
        judged = near_duplicates(docs, id_col, text_col, shingle, percent)
        dropped = saved(judged.filter("NOT kept").select(F.col("doc_id").alias("x_dropped")).distinct(), "mh-dropped", keep=True)
    return docs.join(dropped, docs[id_col].cast("bigint") == dropped["x_dropped"], "left_anti")
