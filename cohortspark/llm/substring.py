"""Substring deduplication with suffix automata of reference shards.

A window is ``length`` consecutive words.  A word goes if a window that covers it also starts in
a document with a smaller id.

1. Equal documents collapse to the one with the smallest id (the others lose every window).
2. Windows are routed by their minimizer, the smallest hash among the ``GRAM``-word runs inside:
   equal windows have equal minimizers, and neighbouring windows mostly share one, so a document
   becomes few stretches.  Only minimizers of two or more documents go on.
3. The distinct stretches of a minimizer, each with its smallest id, are its reference.  References
   are dealt to shards of about ``SHARD_WORDS`` words; a task builds the suffix automaton of one
   shard, with the smallest id for every state, and streams the stretches through it: matching
   statistics cut at ``length`` give, per window, the smallest document that holds it.  A minimizer
   whose stretches alone hold more than ``SHARD_WORDS`` words (a licence line in ever other
   surroundings) is no shard: its windows are told apart one by one by a 128-bit hash, and the
   smallest id of each comes from partial minima.
4. Windows whose smallest document is smaller than their own are merged to maximal spans.

The automata stay with their shard: the reference is the corpus itself, so a broadcast of it
would grow with the data.  A stretch found in a thousand documents is shipped and matched once.

Defined cases: null text has no words; texts shorter than a window lose nothing; rows that repeat an
id with different texts are cut each on its own, by smaller ids only, never by one another (a text is
known by its id and the hash ``tag`` of its characters); rows without an id keep all; an empty table gives
an empty one; columns of any name, those used in here too, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import WordHashes, in_slices, passing, saved, window_hashes, words_of

LENGTH, GRAM, SHARD_WORDS = 50, 12, 60_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def stretches(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, number of windows) of the runs of windows with equal minimizers."""
    if len(hashes) < length:
        return (np.empty(0, np.int64),) * 3
    gram = min(GRAM, length)
    low = sliding_min(window_hashes(hashes, gram), length - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[start].view(np.int64), start, np.diff(np.append(start, len(low)))


class SuffixAutomaton:
    """Of several word sequences; every state knows the smallest id among the texts that hold it."""

    def __init__(self):
        self.next, self.link, self.len, self.low = [{}], [-1], [0], [1 << 63]

    def add(self, words: list, low: int) -> None:
        nxt, link, length, least = self.next, self.link, self.len, self.low
        last = 0
        for w in words:
            if w in nxt[last]:  # known from another text
                q = nxt[last][w]
                if length[q] != length[last] + 1:
                    q = self._clone(last, w, q)
                last = q
                if low < least[last]:
                    least[last] = low
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            least.append(low)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.low.append(self.low[q])
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def finish(self) -> "SuffixAutomaton":
        """A state's texts include those of every state that links to it."""
        for v in np.argsort(-np.array(self.len), kind="stable").tolist()[:-1]:
            if self.low[v] < self.low[self.link[v]]:
                self.low[self.link[v]] = self.low[v]
        return self

    def smallest(self, words: list, length: int) -> list[int]:
        """For each window of ``length`` words, the smallest id that holds it (2^63: none)."""
        nxt, link, size, least = self.next, self.link, self.len, self.low
        out, v, matched = [], 0, 0
        for at, w in enumerate(words, 1):
            while v and w not in nxt[v]:
                v = link[v]
                matched = size[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            while matched >= length and size[link[v]] >= length:
                v = link[v]
            if matched > length:
                matched = length
            if at >= length:
                out.append(least[v] if matched >= length else 1 << 63)
        return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and tag: rows that repeat an id with another text have another tag."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def analysed(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """doc_id, tag, n_words, SHA-256 of the words, and the stretches of every whole text."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        known = WordHashes()
        for batch in in_slices(batches):
            ids, texts, tags = (batch.column(i).to_pylist() for i in range(3))
            for at in range(0, len(ids), 500):
                rows, keys, starts, sizes, ends = [], [], [], [], [0]
                for doc_id, text, tag in zip(ids[at : at + 500], texts[at : at + 500], tags[at : at + 500]):
                    words = words_of(text)
                    m, s, n = stretches(known.of(words), length)
                    keys.append(m), starts.append(s), sizes.append(n)
                    ends.append(ends[-1] + len(m))
                    rows.append((doc_id, tag, len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
                runs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, starts, sizes)], names=["key", "start", "windows"]
                )
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], names=["doc_id", "tag", "n_words", "sha256", "runs"])

    schema = "doc_id bigint, tag bigint, n_words bigint, sha256 string, runs array<struct<key: bigint, start: bigint, windows: bigint>>"
    return keyed(docs, id_col, text_col).mapInArrow(run, schema)


def contents(rows: DataFrame, length: int) -> DataFrame:
    """key, doc_id, tag, start, digest and word hashes of the stretches ``runs`` of each text."""

    def run(batches: Iterator) -> Iterator:
        import xxhash

        known = WordHashes()
        for batch in in_slices(batches, max_bytes=2 << 20):
            out = []
            for doc_id, text, tag, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = known.of(words_of(text))
                for r in runs:
                    raw = h[r["start"] : r["start"] + r["windows"] + length - 1].tobytes()
                    out.append((r["key"], doc_id, tag, r["start"], xxhash.xxh3_128_digest(raw), raw))
            for at in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 5000]), kinds)], names=names)

    names = ["key", "doc_id", "tag", "start", "digest", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return rows.mapInArrow(run, "key bigint, doc_id bigint, tag bigint, start bigint, digest binary, words binary")


def match_shard(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """One shard: automaton of its stretches, then every stretch's windows as runs of equal smallest id."""
    rows = rows.sort_values(["key", "digest"])
    alphabet: dict = {}
    texts = []
    automaton = SuffixAutomaton()
    for raw, low in zip(rows["words"], rows["low"]):
        texts.append([alphabet.setdefault(w, len(alphabet)) for w in np.frombuffer(raw, np.uint64).tolist()])
        automaton.add(texts[-1], low)
    automaton.finish()
    spans = []
    for words in texts:
        found = np.array(automaton.smallest(words, length), np.uint64).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        spans.append([{"at": a, "windows": n, "low": v} for a, n, v in zip(edge.tolist(), np.diff(np.append(edge, len(found))).tolist(), found[edge].tolist())])
    return pd.DataFrame({"key": rows["key"].to_numpy(), "digest": rows["digest"].to_numpy(), "spans": spans})


def match_windows(reference: DataFrame, length: int) -> DataFrame:
    """As ``match_shard``, for keys of too many words: window by window, by hash, without a group per key."""

    def run(batches: Iterator) -> Iterator:
        import xxhash

        for batch in in_slices(batches, max_bytes=1 << 20, column=3):
            out = []
            for key, digest, low, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(len(raw) // 8 - length + 1):
                    out.append((key, digest, low, at, xxhash.xxh3_128_digest(raw[8 * at : 8 * (at + length)])))
            for at in range(0, len(out), 10000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10000]), kinds)], names=names)

    names = ["key", "digest", "low", "at", "window"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    windows = reference.select("key", "digest", "low", "words").mapInArrow(run, "key bigint, digest binary, low bigint, at bigint, window binary")
    windows = saved(windows, "ss-windows")
    # Saved, so that the join below reads two plain shuffles: a window of many stretches is skew, which AQE splits.
    least = saved(windows.groupBy("window").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "ss-least")
    found = windows.join(least, "window", "left").withColumn("low", F.coalesce("least", "low"))
    found = found.groupBy("key", "digest").agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("all"))  # one stretch: its windows
    found = found.withColumn("edges", F.filter("all", lambda w, i: (i == 0) | (F.get("all", i - 1)["low"] != w["low"])))
    upto = lambda i: F.coalesce(F.get("edges", i + 1)["at"], F.size("all").cast("bigint"))
    span = lambda w, i: F.struct(w["at"], (upto(i) - w["at"]).alias("windows"), w["low"])
    return found.select("key", "digest", F.transform("edges", span).alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_words: int = SHARD_WORDS):
    """(analysed rows with ``first``: the smallest id of their words; spans of windows per doc_id and tag; the texts of those)."""
    with passing(docs.sparkSession):
        rows = saved(analysed(docs, id_col, text_col, length), "ss-rows", keep=True)
        firsts = saved(rows.filter("doc_id IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("first")), "ss-firsts", keep=True)
        # One row stands for all equal documents; only stretches shared by two such documents go on.
        runs = rows.join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "tag", F.explode("runs").alias("run"))
        runs = saved(runs.select("doc_id", "tag", "run.*").distinct(), "ss-runs")
        shared = runs.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("key")
        wanted = runs.join(shared, "key").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "start", "windows")).alias("runs"))
        texts = saved(keyed(docs, id_col, text_col).join(wanted, ["doc_id", "tag"]), "ss-texts", keep=True)
        found = saved(contents(texts.select("doc_id", "text", "tag", "runs"), length), "ss-contents", keep=True)
        reference = found.groupBy("key", "digest").agg(F.min("doc_id").alias("low"), F.first("words").alias("words"))
        reference = saved(reference.withColumn("size", F.octet_length("words") / 8), "ss-reference")
        hot = saved(reference.groupBy("key").agg(F.sum("size").alias("size")).filter(F.col("size") > shard_words), "ss-hot")
        hot_words, hot_keys = hot.agg(F.coalesce(F.sum("size"), F.lit(0.0)), F.count(F.lit(1))).first()
        words = reference.agg(F.coalesce(F.sum("size"), F.lit(0.0))).first()[0] - hot_words
        shards = max(1, int(words // shard_words))
        # A key's stretches meet in one shard; AQE must not merge shards into tasks of many.
        cold = reference.join(hot, "key", "left_anti") if hot_keys else reference
        dealt = cold.select("key", "digest", "low", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
        matched = dealt.groupBy("shard").applyInPandas(
            lambda pdf: match_shard(pdf, length), "key bigint, digest binary, spans array<struct<at: bigint, windows: bigint, low: bigint>>"
        )
        if hot_keys:
            matched = matched.unionByName(match_windows(reference.join(hot.select("key"), "key", "left_semi"), length))
        matched = saved(matched, "ss-matched", keep=True)
    hits = found.select("key", "digest", "doc_id", "tag", "start").join(matched, ["key", "digest"])
    hits = hits.withColumn("span", F.explode(F.filter("spans", lambda s: s["low"] < F.col("doc_id"))))
    spans = hits.groupBy("doc_id", "tag").agg(F.collect_set(F.struct((F.col("start") + F.col("span.at")).alias("at"), F.col("span.windows").alias("windows"))).alias("spans"))
    return rows.join(firsts, "sha256", "left"), spans, texts.select("doc_id", "tag", "text")


def cut_texts(spans: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """doc_id, tag, number of removed words and the words that stay, joined by single spaces."""

    def run(batches: Iterator) -> Iterator:
        for batch in in_slices(batches):
            out = []
            for doc_id, text, tag, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["at"]] += 1
                    edge[s["at"] + s["windows"] + length - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                out.append((doc_id, tag, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "tag", "n_cut", "kept_text"])

    return texts.join(spans, ["doc_id", "tag"]).select("doc_id", "text", "tag", "spans").mapInArrow(run, "doc_id bigint, tag bigint, n_cut bigint, kept_text string")


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Per row: doc_id, tag, n_words, n_removed, sha256 of all words, kept_text (null: nothing was removed)."""
    rows, spans, texts = repeated_spans(docs, id_col, text_col, length, shard_words)
    cut = cut_texts(spans, texts.dropDuplicates(["doc_id", "tag"]), length).withColumnsRenamed({"doc_id": "x_doc", "tag": "x_tag"})
    out = rows.join(cut, (rows["doc_id"] == cut["x_doc"]) & (rows["tag"] == cut["x_tag"]) & (rows["doc_id"] == rows["first"]), "left")
    copy = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= length), F.lit(False))
    return out.select(
        "doc_id", "tag", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("bigint").alias("n_removed"),
        "sha256", F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated spans cut from the text; texts without such spans stay as they are."""
    with passing(docs.sparkSession):
        found = saved(dedup_substrings(docs, id_col, text_col, length).filter("n_removed > 0"), "ss-cut", keep=True)
    found = found.select(F.struct("doc_id", "tag").alias("at"), "kept_text").dropDuplicates(["at"]).alias("x_found")
    text = F.col(f"x_docs.`{text_col}`").cast("string")
    at = F.struct(F.col(f"x_docs.`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tag"))
    out = docs.alias("x_docs").join(found, at == F.col("x_found.at"), "left")
    columns = [F.col(f"x_docs.`{c}`") for c in docs.columns]
    return out.select(*[F.coalesce("x_found.kept_text", c).alias(n) if n == text_col else c for n, c in zip(docs.columns, columns)])
