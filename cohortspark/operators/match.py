"""Keyword and phrase matching with negation (ops 60-63, 65-67).

* Regex flags: one case-insensitive alternation per category, evaluated by
  ``rlike`` inside the scan's projection (no shuffle, no Python).
* Phrase matches: texts are cut into tokens, n-grams of the vocabulary's phrase
  lengths are built with array functions and equi-joined with the phrase table
  (broadcast behind a size check).  The work grows with the text, not with the
  vocabulary.  Every token knows its scope segment, so a phrase may hold a mark.
* Negation: one sweep over each document's matches in token order.  Targets and
  cues are shuffled once, by document; scopes, void cues and flags are running
  and whole-frame windows over that order, never pairs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions import text as tx
from cohortspark.operators.joins import bounded_broadcast

# Token rule for phrase matching: word runs, and every other non-space character alone.
PHRASE_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"
# A scope ends after a sentence end or a termination cue; a full stop between two digits is a decimal point.
SCOPE_END = r"(?<=[;!?])|(?<=\.)(?![0-9])|(?<=[^0-9]\.)|(?<=^\.)"


# --------------------------------------------------------------------------- #
# Regex flags                                                                 #
# --------------------------------------------------------------------------- #
def category_patterns(vocab: DataFrame) -> dict[str, list[str]]:
    """The (category, pattern) configuration table as {category: [patterns]} in pattern order."""
    rows = vocab.select("category", "pattern").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["category"], []).append(r["pattern"])
    return out


def regex_flag(text, patterns: list[str], whole_word: bool = False) -> Column:
    """1 if any pattern is found (case-insensitive), 0 otherwise; null text -> 0; no patterns -> 0."""
    if not patterns:
        return F.lit(0)
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(tx.holds(c, patterns, whole_word), F.lit(False)).cast("int")


def regex_flags(
    df: DataFrame, vocab: DataFrame, text_col: str = "text", whole_word: bool = False,
    categories: list[str] | None = None, prefix: str = "pred_",
) -> DataFrame:
    """Add ``pred_<category>`` for every category (unknown category -> zeros; missing column -> zeros)."""
    pats = category_patterns(vocab)
    cats = categories or sorted(pats)
    if text_col not in df.columns:
        return df.withColumns({f"{prefix}{c.lower()}": F.lit(0) for c in cats})
    return df.withColumns({f"{prefix}{c.lower()}": regex_flag(text_col, pats.get(c, []), whole_word) for c in cats})


def regex_flags_long(
    df: DataFrame, vocab: DataFrame, text_col: str = "text", whole_word: bool = False,
    categories: list[str] | None = None,
) -> DataFrame:
    """Long form: one row per input row and category with ``category, pred``."""
    pats = category_patterns(vocab)
    cats = categories or sorted(pats)
    entries = [F.struct(F.lit(c).alias("category"), regex_flag(text_col, pats.get(c, []), whole_word).alias("pred")) for c in cats]
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_f")).select(*keep, "_f.category", "_f.pred")


def combine_categories(*flags) -> Column:
    """OR of category flags; one present -> that one; none -> null (greatest skips nulls)."""
    cols = [F.col(f) if isinstance(f, str) else f for f in flags]
    if not cols:
        return F.lit(None).cast("int")
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def pattern_with_concept(vocab: DataFrame) -> DataFrame:
    """Allow an optional bracketed concept id after each pattern (op 62)."""
    return vocab.withColumn("pattern", F.concat(F.col("pattern"), F.lit(r"(?:\s*\(C\d{4,}\))?")))


CONCEPT_ID_PATTERN = r"\(C\d{4,}\)"


# --------------------------------------------------------------------------- #
# Text normalisation (op 63): NFKC has no Spark built-in -> one Arrow UDF      #
# --------------------------------------------------------------------------- #
@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise_text(text, nfkc: bool = True) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    c = _nfkc(c) if nfkc else c
    return F.translate(c, "’", "'")


# --------------------------------------------------------------------------- #
# Phrase matching (op 65)                                                     #
# --------------------------------------------------------------------------- #
def phrase_table(phrases: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """Vocabulary -> (key, n_words, *other columns); regex marks stripped, optional chars expanded.

    ``\\b`` marks are removed; an optional character ``x?`` yields two phrases
    (with and without it), so ``crohn'?s`` matches ``crohn's`` and ``crohns``.
    """
    p = F.regexp_replace(F.lower(F.col(phrase_col)), r"\\b", "")
    with_opt = F.regexp_replace(p, r"(.)\?", "$1")
    without_opt = F.regexp_replace(p, r".\?", "")
    variants = F.array_distinct(F.array(with_opt, without_opt))
    others = [c for c in phrases.columns if c != phrase_col]
    t = phrases.select(*others, F.col(phrase_col), F.explode(variants).alias("_p"))
    toks = F.regexp_extract_all(F.col("_p"), F.lit(PHRASE_TOKEN), 0)
    return (
        t.select(*others, F.col(phrase_col), F.array_join(toks, " ").alias("key"), F.size(toks).alias("n_words"))
        .filter(F.col("n_words") > 0)
        .dropDuplicates([*others, "key"])
    )


def _lengths(ptab: DataFrame) -> list[int]:
    return sorted(r[0] for r in ptab.select("n_words").distinct().collect())


# Vocabularies up to this many keys are also applied as an in-row hash-set pre-filter.
PREFILTER_MAX_KEYS = 100_000


def _grams_of_length(k: int, firsts: list[str] | None = None, keys: list[str] | None = None) -> Column:
    """Array of (start, n_words, seg, seg_last, seg_at, key) structs for the k-grams of the token array ``_t``.

    Lambdas take one argument only (a second one would be bound to the index),
    so ``k`` is captured by this closure.  With a bounded vocabulary, grams are
    built only at tokens that start some phrase and kept only if their key is a
    phrase (both hash-set lookups inside the row), so the explode emits matches
    instead of every n-gram of the text.
    """
    def make(i):
        return F.struct((i - 1).alias("start"), F.lit(k).alias("n_words"), F.array_join(F.slice("_t", i, k), " ").alias("key"))

    def place(x):
        seg = F.get("_seg", x["start"])
        last = F.get("_seg", x["start"] + (k - 1)).alias("seg_last")
        return F.struct(x["start"], x["n_words"], seg.alias("seg"), last, (x["start"] - F.get("_place", x["start"])).alias("seg_at"), x["key"])

    starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - k + 1, F.lit(1)))
    if firsts is not None:
        starts = F.filter(starts, lambda i: F.coalesce(F.try_element_at("_t", i).isin(*firsts), F.lit(False)))
    g = F.filter(F.transform(starts, make), lambda x: x["start"] + k <= F.size("_t"))
    if keys is not None:
        g = F.filter(g, lambda x: x["key"].isin(*keys))
    return F.transform(g, place)


def text_ngrams(
    df: DataFrame, id_cols: list[str], text_col: str, lengths: list[int], scoped: bool, keys: list[str] | None = None,
) -> DataFrame:
    """(ids, start, n_words, seg, seg_last, seg_at, key) for the n-grams of the given lengths (only vocabulary keys when given).

    ``start`` counts the tokens of the whole text; ``seg`` and ``seg_last`` are the scope
    segments of the first and last token, ``seg_at`` is the first token of ``seg``.  A segment
    keeps the mark that ends it as its last token.  All row-local, no window, no shuffle.
    """
    txt = F.coalesce(F.col(text_col), F.lit(""))
    segs = F.split(txt, SCOPE_END) if scoped else F.array(txt)
    s = df.select(*id_cols, F.transform(segs, lambda x: F.regexp_extract_all(F.lower(x), F.lit(PHRASE_TOKEN), 0)).alias("_parts"))
    s = s.select(
        *id_cols, F.flatten("_parts").alias("_t"),
        F.flatten(F.transform("_parts", lambda x, i: F.array_repeat(i, F.size(x)))).alias("_seg"),
        # Of every token, its place in the segment.
        F.flatten(F.transform("_parts", lambda x: F.filter(F.sequence(F.lit(0), F.size(x)), lambda n: n < F.size(x)))).alias("_place"),
    )
    s = s.filter(F.size("_t") > 0)
    firsts = sorted({k.split(" ")[0] for k in keys}) if keys is not None else None
    grams = [_grams_of_length(k, firsts, keys) for k in lengths]
    allg = F.flatten(F.array(*grams)) if len(grams) > 1 else grams[0]
    return s.select(*id_cols, F.explode(allg).alias("_g")).select(*id_cols, "_g.*")


def _vocab_keys(ptab: DataFrame) -> tuple[list[int], list[str] | None]:
    """Phrase lengths, and the keys themselves when the vocabulary is small enough for a pre-filter."""
    rows = ptab.select("key", "n_words").distinct().limit(PREFILTER_MAX_KEYS + 1).collect()
    lengths = sorted({r["n_words"] for r in rows})
    if len(rows) > PREFILTER_MAX_KEYS:
        return sorted(r[0] for r in ptab.select("n_words").distinct().collect()), None
    return lengths, sorted({r["key"] for r in rows})


def _phrase_hits(
    df: DataFrame, id_cols: list[str], text_col: str, phrases: DataFrame, phrase_col: str, scoped: bool, needed: str = "true",
) -> DataFrame:
    """Matches at their place in the whole text, with the columns of ``text_ngrams`` and the vocabulary.

    Texts that hold no phrase of the rows ``needed`` may be left out: they are not cut into tokens.
    """
    ptab = phrase_table(phrases, phrase_col)
    lengths, keys = _vocab_keys(ptab)
    must = keys if needed == "true" else _vocab_keys(ptab.filter(needed))[1]
    longest = [max(k.split(" "), key=len) for k in must or []]
    if tx.one_by_one(longest):
        df = df.filter(tx.holds(F.col(text_col), longest, whole=False))
    if not lengths:  # an empty vocabulary: the join below gives no rows, with all its columns
        lengths, keys = [1], None
    grams = text_ngrams(df, id_cols, text_col, lengths, scoped, keys)
    return grams.join(bounded_broadcast(ptab), on=["key", "n_words"], how="inner")


def phrase_match(
    df: DataFrame, id_cols: list[str], text_col: str, phrases: DataFrame,
    phrase_col: str = "phrase", scoped: bool = False,
) -> DataFrame:
    """Whole-token, case-insensitive matches: (ids, seg, start, end, key, vocabulary columns).

    Scoped, ``seg`` is the segment of the first token and ``start`` counts from its first token;
    a phrase that holds a scope mark is found all the same.
    """
    hits = _phrase_hits(df, id_cols, text_col, phrases, phrase_col, scoped)
    hits = hits.withColumn("start", F.col("start") - F.col("seg_at")).drop("seg_last", "seg_at")
    return hits.withColumn("end", F.col("start") + F.col("n_words"))


# --------------------------------------------------------------------------- #
# Negation (op 66) and flags (op 67)                                          #
# --------------------------------------------------------------------------- #
def negated_match(
    df: DataFrame, id_cols: list[str], text_col: str, targets: DataFrame, cues: DataFrame,
    target_col: str = "phrase", scope: str = "match",
) -> DataFrame:
    """Target matches with a ``negated`` flag.

    Scopes are the segments of the text; a mark inside a matched phrase, target or cue
    ("st. john's wort"), ends no scope, nor does a decimal point.  Per scope:
    * a cue whose start lies inside a pseudo cue [start, end] (end inclusive) is void;
    * a target is negated if a preceding cue starts before it, or a following
      cue ends after it, in the same scope.
    ``seg`` is the scope's first segment, ``start`` and ``end`` count from its first token.
    ``scope='off'`` returns plain matches with ``negated = false``.

    One sweep: the matches meet by document, in one shuffle; scopes that a phrase joins follow
    from the last segment reached so far, void cues from the furthest end of the pseudo cues
    started so far.
    """
    if scope == "off":
        return phrase_match(df, id_cols, text_col, targets, target_col, scoped=True).withColumn("negated", F.lit(False))
    # one n-gram pass for targets and cues: a combined vocabulary tagged by kind
    others = [c for c in targets.columns if c != target_col]
    tv = targets.select(*others, F.col(target_col).alias("_phrase"), F.lit("target").alias("kind"))
    cv = cues.select(*[F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in others], F.col("phrase").alias("_phrase"), "kind")
    hits = _phrase_hits(df, id_cols, text_col, tv.unionByName(cv), "_phrase", scoped=True, needed="kind = 'target'")
    hits = hits.withColumn("end", F.col("start") + F.col("n_words"))
    in_order = Window.partitionBy(*id_cols).orderBy("start")
    reached = F.max("seg_last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("seg") > reached, F.lit(True))
    hits = hits.withColumn("_opens", opens).withColumn("_scope", F.sum(F.col("_opens").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*id_cols, "_scope")
    so_far = whole.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pseudo_end = F.max(F.when(F.col("kind") == "pseudo", F.col("end"))).over(so_far)
    hits = hits.withColumn("_live", ~F.coalesce(pseudo_end >= F.col("start"), F.lit(False)))
    first_pre = F.min(F.when((F.col("kind") == "preceding") & F.col("_live"), F.col("start"))).over(whole)
    last_fol = F.max(F.when((F.col("kind") == "following") & F.col("_live"), F.col("end"))).over(whole)
    neg = F.coalesce(first_pre < F.col("start"), F.lit(False)) | F.coalesce(last_fol > F.col("end"), F.lit(False))
    out = hits.select("*", neg.alias("negated"), F.min("seg").over(whole).alias("_seg"), F.min("seg_at").over(whole).alias("_from"))
    out = out.filter(F.col("kind") == "target").withColumns({
        "seg": F.col("_seg"), "start": F.col("start") - F.col("_from"), "end": F.col("end") - F.col("_from"),
    })
    return out.drop("kind", "_opens", "_scope", "_live", "_seg", "_from", "seg_last", "seg_at").withColumnRenamed("_phrase", target_col)


def phrase_flags(
    docs: DataFrame, id_cols: list[str], matches: DataFrame, categories: list[str],
    category_col: str = "category", prefix: str = "pred_",
) -> DataFrame:
    """Per document: 1/0 per category and for either, from non-negated matches; docs without hits -> 0."""
    m = matches.filter(~F.col("negated")) if "negated" in matches.columns else matches
    aggs = [F.max((F.col(category_col) == c).cast("int")).alias(f"{prefix}{c.lower()}") for c in categories]
    aggs.append(F.max(F.col(category_col).isin(*categories).cast("int")).alias(f"{prefix}any"))
    per_doc = m.groupBy(*id_cols).agg(*aggs)
    cols = [f"{prefix}{c.lower()}" for c in categories] + [f"{prefix}any"]
    return docs.join(per_doc, on=id_cols, how="left").fillna(0, subset=cols)
