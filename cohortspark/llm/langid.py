"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes the counts of its hashed byte n-grams (one to three bytes, lower case), damped by
a logarithm, weighted by inverse document frequency and scaled to length 1.  Each language has
several centroids from spherical k-means on a bounded sample of labelled rows (``per_language``).
The language of the centroid with the largest cosine wins; a text further from every centroid
than ``slack`` allows beyond the farthest training text is rejected.

Defined cases: null text or text without a letter is ``und`` with score 0 and rejected; ties go
to the first language in alphabetical order; without training rows every text is ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import in_slices

BUCKETS, UNDETERMINED = 4096, "und"
#: Texts whose vectors are held at a time: 4 MB an array.
ROWS = 256
_MULTIPLIERS = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


#: ASCII other than lower-case letters reads as a space: signs and digits say nothing of the language.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the whole text's 1- to 3-byte runs in hashed buckets, words set off by one space."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.float32)
    key = np.zeros(len(b), np.uint32)
    for n, m in enumerate(_MULTIPLIERS):
        if len(b) <= n:
            break
        key = (key[: len(b) - n] + b[n:] + np.uint32(1)) * m
        out += np.bincount((key ^ (key >> np.uint32(15))) >> np.uint32(3) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    """idf, centroids with their languages, and the least cosine that is not rejected."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], least: float):
        self.idf, self.centres, self.langs, self.least = idf.astype(np.float32), centres.astype(np.float32), langs, least

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = self.vectors(counts) @ self.centres.T
        best = np.argmax(cosines, axis=1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1)

    @classmethod
    def fit(cls, counts: np.ndarray, langs: list[str], per_language: int, rounds: int, slack: float, spare: bool = False) -> "Centroids":
        """``spare``: ``counts`` (32-bit floats) may be overwritten, so that one array of all rows is held, not two."""
        spans = [slice(at, at + ROWS) for at in range(0, len(counts), ROWS)]  # temporaries stay of one size
        idf = np.log((1 + len(counts)) / (1 + sum((counts[s] > 0).sum(axis=0) for s in spans))) + 1
        x = counts if spare else np.empty(counts.shape, np.float32)
        for s in spans:
            x[s] = unit_rows(np.log1p(counts[s].astype(np.float32)) * idf)
        names, own = np.unique(np.array(langs), return_inverse=True)
        centres, of = [], []
        rng = np.random.default_rng(5)
        for k, name in enumerate(names):
            at = np.flatnonzero(own == k)
            rows = x[at[0] : at[-1] + 1] if at[-1] - at[0] + 1 == len(at) else x[at]  # languages in order need no copy
            c = rows[np.sort(rng.choice(len(rows), min(per_language, len(rows)), replace=False))]
            for _ in range(rounds):
                near = np.argmax(rows @ c.T, axis=1)
                c = unit_rows(np.stack([rows[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
            centres.append(c)
            of += [str(name)] * len(c)
        centres = np.concatenate(centres)
        return cls(idf, centres, of, slack * float(min((x[s] @ centres.T).max(axis=1).min() for s in spans)))


def fit_centroids(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    per_language: int = 1000, clusters: int = 4, rounds: int = 8, slack: float = 0.5,
) -> Centroids | None:
    """Learn from about ``per_language`` labelled rows of each language (the documented bound).

    Rows are drawn by a hash of id and text with a chance that follows the language's count.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    chance = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])[F.col(lang_col)]
    drawn = F.pmod(F.xxhash64(F.lit(11), id_col, text_col), F.lit(1 << 30)) < chance * F.lit(float(1 << 30))

    def run(batches: Iterator) -> Iterator:
        for batch in in_slices(batches):
            vectors = [zlib.compress(ngram_counts(t).astype("<u4").tobytes(), 1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["lang", "counts"])

    got = rows.filter(drawn).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, counts binary")
    found = [(r["lang"], bytes(r["counts"])) for r in got.toLocalIterator()]
    if not found:
        return None
    matrix = np.empty((len(found), BUCKETS), np.float32)
    langs = []
    # Compressed until a language's turn, whose rows are ordered by their counts' bytes.
    for name in sorted({lang for lang, _ in found}):
        for c in sorted(zlib.decompress(c) for lang, c in found if lang == name):
            matrix[len(langs)] = np.frombuffer(c, "<u4")
            langs.append(name)
    del found
    return Centroids.fit(matrix, langs, clusters, rounds, slack, spare=True)


def identify(docs: DataFrame, model: Centroids | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score and rejected (they replace columns so named)."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    place = keep.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import regex

        has_letter = regex.compile(r"\p{L}").search
        for batch in in_slices(batches, max_bytes=4 << 20, column=place):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(place).to_pylist()
                known = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
                lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if known:
                    best, cosine = model.nearest(np.stack([ngram_counts(texts[i]) for i in known]))
                    score[known], rejected[known] = cosine, cosine < model.least
                    for i, b in zip(known, best.tolist()):
                        lang[i] = model.langs[b]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*keep, "lang_pred", "score", "rejected"],
                )

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", lang_pred string, score double, rejected boolean"
    return kept.toDF(*[f"x{i}" for i in range(len(keep))]).mapInArrow(run, schema)  # a name there may hold no dot


def held_out(bucket: Column, value: int = 2) -> Column:
    return F.coalesce(bucket == value, F.lit(False))
