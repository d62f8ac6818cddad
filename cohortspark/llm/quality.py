"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts, in one pass over Arrow batches.  The trees are grown in numpy
on a bounded sample of labelled rows (``fit_rows``), with monotonic constraints: a split on a
constrained feature may only order its leaves the allowed way, and its children inherit the
bound between them.  The ensemble is flattened into node arrays; scoring walks all trees of all
documents at once, one array step per level.

Defined cases: null text has no words; rows without a label are scored, not learned from; with
fewer than two classes among the labels no trees are grown and the base rules decide alone;
repeated rows give repeated results, repeated labels count by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import in_slices, saved, window_hashes

SYMBOLS, WHITE = "#*$%&|<>", " \t\n\v\f\r"
WINDOW_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Shares derived from the statistics, and the only direction in which each may move the
#: verdict (-1: more of it never helps; 0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "top_word_share": -1, "upper_share": -1, "bang_share": -1, "digit_share": 0, "line_words": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{f} double" for f in FEATURES)


def statistics(text: str | None) -> tuple:
    """The counts of the contract and the features of the trees for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    keys = np.fromiter(map(hash, words), np.int64, n)
    covered = 0
    if n > WINDOW_WORDS:
        h = window_hashes(keys.view(np.uint64), WINDOW_WORDS)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(n + 1, np.int64)
            at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            np.add.at(twice, at, 1)
            np.add.at(twice, at + WINDOW_WORDS, -1)
            covered = int((np.cumsum(twice)[:n] > 0).sum())
    counts = np.unique(keys, return_counts=True)[1] if n else np.zeros(1)
    letters = max(1, chars)
    upper = sum(map(bytes.isupper, words))
    return (
        n, chars, symbols, dup, covered,
        float(np.log1p(n)), chars / max(1, n), symbols / letters, dup / max(1, len(lines)), covered / max(1, n),
        len(counts) / max(1, n), float(counts.max()) / max(1, n), upper / max(1, n), text.count("!") / letters,
        sum(map(text.count, "0123456789")) / letters, n / max(1, len(lines)),
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        types = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
        for batch in in_slices(batches):
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *COUNTS, *FEATURES])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, STATS_SCHEMA)


class Trees:
    """Boosted trees for a yes/no label, as node arrays: feature (-1 in leaves), split, children, value."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 64, min_rows: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.min_rows, self.ridge = rounds, depth, rate, bins, min_rows, ridge
        self.feature, self.split, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, direction: np.ndarray) -> "Trees":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
            self.roots.append(len(self.value))
            self._grow(binned, edges, grad, hess, np.arange(len(y)), direction, -np.inf, np.inf, self.depth, score)
        return self.flatten()

    def _leaf(self, g: np.ndarray | float, h: np.ndarray | float):
        return -g / (h + self.ridge)

    def _grow(self, binned, edges, grad, hess, rows, direction, low, high, depth, score) -> int:
        node = len(self.value)
        g, h = grad[rows].sum(), hess[rows].sum()
        own = float(np.clip(self._leaf(g, h), low, high))
        for column, v in ((self.feature, -1), (self.split, 0.0), (self.left, node), (self.right, node), (self.value, own * self.rate)):
            column.append(v)
        best = (1e-6, None)
        if depth and len(rows) >= 2 * self.min_rows:
            gain_of = lambda g, h, v: -(g * v + 0.5 * (h + self.ridge) * v * v)
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = binned[rows, f]
                size = len(cuts) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
                lv, rv = np.clip(self._leaf(cg, ch), low, high), np.clip(self._leaf(g - cg, h - ch), low, high)
                gain = gain_of(cg, ch, lv) + gain_of(g - cg, h - ch, rv) - gain_of(g, h, own)
                gain[(cn < self.min_rows) | (len(rows) - cn < self.min_rows)] = 0
                if direction[f]:
                    gain[direction[f] * (rv - lv) < 0] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, lv[k], rv[k]))
        if best[1] is None:
            score[rows] += own * self.rate
            return node
        f, k, lv, rv = best[1]
        goes_left = binned[rows, f] <= k
        mid = (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(direction[f])]
        self.feature[node], self.split[node] = f, float(edges[f][k])
        self.left[node] = self._grow(binned, edges, grad, hess, rows[goes_left], direction, *bounds[0], depth - 1, score)
        self.right[node] = self._grow(binned, edges, grad, hess, rows[~goes_left], direction, *bounds[1], depth - 1, score)
        return node

    def flatten(self) -> "Trees":
        for name, kind in (("feature", np.int32), ("split", float), ("left", np.int32), ("right", np.int32), ("value", float), ("roots", np.int32)):
            setattr(self, name, np.asarray(getattr(self, name), kind))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of a yes for each row: all trees step down together."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.split[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, down)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit_trees(stats: DataFrame, labels: DataFrame, fit_rows: int = 20_000, label_col: str = "quality", id_col: str = "doc_id") -> Trees | None:
    """Learn from about ``fit_rows`` labelled rows, drawn by a hash of the id (the documented bound)."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    y = y.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    n = y.count()
    drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, fit_rows / max(1, n)) * (1 << 30)))
    rows = stats.filter(drawn).join(y.filter(drawn), "doc_id").select("doc_id", "y", *FEATURES).toPandas().sort_values(["doc_id", *FEATURES])
    target = (rows["y"].to_numpy() >= 0.5).astype(float)
    if len(np.unique(target)) < 2:
        return None
    return Trees().fit(rows[list(FEATURES)].to_numpy(), target, np.array(list(FEATURES.values())))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Per document: counts, features, base_failed, probability (null without trees) and kept."""
    stats = saved(document_statistics(docs, id_col, text_col), "quality-stats")
    trees = fit_trees(stats, labels, fit_rows)

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(trees.predict(np.stack([c.to_numpy() for c in columns], axis=1)))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = stats.withColumn("base_failed", failed)
    scored = scored.withColumn("probability", probability(*FEATURES) if trees else F.lit(None).cast("double"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce("probability", F.lit(1.0)) >= threshold))
