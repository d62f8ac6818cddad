"""Concept vocabularies: lookup, filtering, preferred terms, term standardisation (ops 31-33, 64).

Concept rows: ``CUI, LAT, TS, ISPREF, TTY, STR, ord`` (``ord`` = position in the
source file, so "first" and "last" are well defined).  All work is joins and
aggregates; concept tables are joined by equi-join on normalised strings,
broadcast only behind a row-count check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortspark.operators.joins import bounded_broadcast
from cohortspark.session import saved_table

PREFERRED_KINDS = ("PT", "PN", "BN", "IN")
FILTER_KINDS = ("PT", "SY")
# Pieces: maximal word runs and maximal non-word runs; their concatenation is the text.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
WORDCH = r"^[\p{L}\p{N}_]"


def _norm(c) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


# op 31
def term_to_concepts(concepts: DataFrame, terms: DataFrame, term_col: str = "term", keep_empty: bool = True) -> DataFrame:
    """Per term: sorted distinct concept ids whose string equals the term ignoring case and outer spaces."""
    c = concepts.select(_norm("STR").alias("_k"), "CUI")
    t = terms.select(F.col(term_col), _norm(term_col).alias("_k"))
    j = t.join(c, on="_k", how="left" if keep_empty else "inner")
    out = j.groupBy(term_col).agg(F.array_sort(F.collect_set("CUI")).alias("cuis"))
    return out


# op 32
def relevant_concepts(
    concepts: DataFrame, patterns: list[str], kinds=FILTER_KINDS, english_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Two passes: ids with a kept string matching any pattern; then every kept row of those ids.

    Returns (rows, counts) where counts has the rows dropped by language, by
    kind, and by not belonging to a matching concept.
    """
    lang_ok = (F.col("LAT") == "ENG") if english_only else F.lit(True)
    kind_ok = F.col("TTY").isin(*kinds)
    kept = concepts.filter(lang_ok & kind_ok)
    rx = "(?iu)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    ids = kept.filter(F.col("STR").rlike(rx)).select("CUI").distinct()
    rows = kept.join(ids, on="CUI", how="left_semi")
    counts = concepts.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~lang_ok).alias("dropped_language"),
        F.count_if(lang_ok & ~kind_ok).alias("dropped_kind"),
    )
    return rows, counts


def relevant_concepts_observed(
    concepts: DataFrame, patterns: list[str], kinds=FILTER_KINDS, english_only: bool = True,
) -> tuple[DataFrame, dict[str, int]]:
    """The rows of ``relevant_concepts``, written once, and the counts that this very run observed.

    Counts: rows_in, dropped_language, dropped_kind, dropped_concept (kept rows of no matching concept).
    No second scan counts them.  A stage that runs again after a lost executor may be observed twice;
    where that matters, count with ``relevant_concepts``.
    """
    lang_ok = F.coalesce(F.col("LAT") == "ENG", F.lit(False)) if english_only else F.lit(True)
    kind_ok = F.coalesce(F.col("TTY").isin(*kinds), F.lit(False))
    before, after = Observation(), Observation()
    seen = concepts.observe(
        before, F.count(F.lit(1)).alias("rows_in"), F.count_if(~lang_ok).alias("dropped_language"),
        F.count_if(lang_ok & ~kind_ok).alias("dropped_kind"),
    )
    rx = "(?iu)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    ids = concepts.filter(lang_ok & kind_ok & F.col("STR").rlike(rx)).select("CUI").distinct()
    rows = seen.filter(lang_ok & kind_ok).join(ids, on="CUI", how="left_semi")
    rows = saved_table(rows.observe(after, F.count(F.lit(1)).alias("rows_out")), "concepts")
    counts = dict(before.get)
    counts["dropped_concept"] = counts["rows_in"] - counts["dropped_language"] - counts["dropped_kind"] - after.get["rows_out"]
    return rows, counts


# op 33
def preferred_terms(concepts: DataFrame, kinds=PREFERRED_KINDS) -> tuple[DataFrame, DataFrame]:
    """(concept -> first preferred string) and (alias -> preferred string of the alias's LAST concept, else alias).

    Both are aggregates by file order (``min_by`` / ``max_by`` on ``ord``).
    """
    pref_ok = ((F.col("TS") == "P") | (F.col("ISPREF") == "Y")) & F.col("TTY").isin(*kinds)
    cui_pref = concepts.filter(pref_ok).groupBy("CUI").agg(F.min_by("STR", "ord").alias("preferred"))
    alias = concepts.groupBy(F.lower(F.col("STR")).alias("alias")).agg(
        F.max_by("CUI", "ord").alias("CUI"), F.min("ord").alias("ord")
    )
    term_pref = alias.join(cui_pref, on="CUI", how="left").select(
        "alias", F.coalesce(F.col("preferred"), F.col("alias")).alias("preferred"), "CUI", "ord"
    )
    return cui_pref, term_pref


# op 64
def standardise_terms(
    df: DataFrame, id_col: str, text_col: str, terms: DataFrame, out: str | None = None, nfkc: bool = True,
) -> DataFrame:
    """Replace known phrases (whole words, case-insensitive) by their preferred form.

    Semantics of one alternation scanned left to right: the leftmost match wins;
    at one start, the phrase with more words wins, then the earlier phrase
    (``ord``).  Null text becomes ''.  Finally a literal ``?s`` becomes ``'s``.

    Plan: text -> pieces (word runs and separators, concatenating to the text);
    candidate n-grams of pieces equi-joined with the term table; per document
    the sorted candidates are folded (``aggregate``) into non-overlapping
    replacements; pieces are rebuilt with ``transform`` + map lookup.
    """
    from cohortspark.functions.text import holds, one_by_one
    from cohortspark.operators.match import normalise_text

    out = out or text_col
    txt = F.coalesce(F.col(text_col), F.lit(""))
    if nfkc:
        txt = normalise_text(txt, nfkc=True)
    else:
        txt = F.translate(txt, "’", "'")
    base = df.withColumn("_txt", txt)
    pieces = F.regexp_extract_all(F.col("_txt"), F.lit(PIECE), 0)

    t = terms.select(
        F.lower(F.col("alias")).alias("_key"),
        F.col("preferred").alias("_pref"),
        F.col("ord").alias("_ord"),
        F.size(F.regexp_extract_all(F.lower(F.col("alias")), F.lit(PIECE), 0)).alias("_len"),
        F.size(F.split(F.trim(F.col("alias")), r"\s+")).alias("_words"),
    )
    t = t.filter(F.col("_key").rlike(WORDCH) & F.reverse(F.col("_key")).rlike(WORDCH))
    # Of equal aliases the earliest row counts.
    t = t.groupBy("_key").agg(F.min(F.struct("_ord", "_pref", "_len", "_words")).alias("_first")).select("_key", "_first.*")
    from cohortspark.operators.match import PREFILTER_MAX_KEYS

    rows = t.select("_key", "_len").limit(PREFILTER_MAX_KEYS + 1).collect()
    lens = sorted({r["_len"] for r in rows})
    if len(rows) > PREFILTER_MAX_KEYS:
        lens, keys, firsts = sorted(r[0] for r in t.select("_len").distinct().collect()), None, None
    else:
        import regex

        keys = sorted({r["_key"] for r in rows})
        firsts = sorted({regex.match(PIECE, k).group(0) for k in keys})
    if not lens:
        return df.withColumn(out, F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("?s"), F.lit("'s")))

    def grams(L):
        def make(i):
            return F.struct((i - 1).alias("start"), F.lit(L).alias("len"), F.lower(F.array_join(F.slice("_pc", i, L), "")).alias("key"))

        def ok(x):
            return (x["start"] + L <= F.size("_pc")) & F.coalesce(F.try_element_at("_pc", x["start"] + 1).rlike(WORDCH), F.lit(False))

        starts = F.sequence(F.lit(1), F.greatest(F.size("_pc") - L + 1, F.lit(1)))
        if firsts is not None:
            # hash-set pre-filter inside the row: grams only where a vocabulary phrase can start
            starts = F.filter(starts, lambda i: F.coalesce(F.lower(F.try_element_at("_pc", i)).isin(*firsts), F.lit(False)))
        g = F.filter(F.transform(starts, make), ok)
        return F.filter(g, lambda x: x["key"].isin(*keys)) if keys is not None else g

    allg = F.flatten(F.array(*[grams(L) for L in lens])) if len(lens) > 1 else grams(lens[0])
    # Texts without an alias stay as they are.
    may = base.filter(holds(F.col("_txt"), keys, whole=False)) if one_by_one(keys or []) else base
    cand = may.select(id_col, pieces.alias("_pc")).select(id_col, F.explode(allg).alias("g")).select(id_col, "g.start", "g.len", F.col("g.key").alias("_key"))
    cand = cand.join(bounded_broadcast(t), on="_key", how="inner").filter(F.col("len") == F.col("_len"))
    # sequential leftmost-first resolution inside one document
    per_doc = cand.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("start").alias("start"), (-F.col("_words")).alias("nw"), F.col("_ord").alias("ord"),
            F.col("len").alias("len"), F.col("_pref").alias("pref"),
        ))).alias("_cands")
    )
    init = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,len:int,pref:string>>").alias("kept"))

    def step(acc, x):
        take = x["start"] >= acc["end"]
        item = F.struct(x["start"].alias("start"), x["len"].alias("len"), x["pref"].alias("pref"))
        return F.when(take, F.struct((x["start"] + x["len"]).alias("end"), F.array_append(acc["kept"], item).alias("kept"))).otherwise(acc)

    per_doc = per_doc.select(id_col, F.aggregate("_cands", init, step)["kept"].alias("_kept"))
    # index -> replacement ('' for pieces covered by a replacement after its first)
    cover = F.flatten(F.transform("_kept", lambda k: F.transform(
        F.sequence(k["start"], k["start"] + k["len"] - 1),
        lambda i: F.struct(i.alias("i"), F.when(i == k["start"], k["pref"]).otherwise(F.lit("")).alias("r")),
    )))
    per_doc = per_doc.select(id_col, F.map_from_entries(cover).alias("_rep"))
    j = base.join(per_doc, on=id_col, how="left")
    rebuilt = F.array_join(
        F.transform(pieces, lambda p, i: F.coalesce(F.try_element_at(F.col("_rep"), i), p)), ""
    )
    res = F.when(F.col("_rep").isNull(), F.col("_txt")).otherwise(rebuilt)
    return j.withColumn(out, F.replace(res, F.lit("?s"), F.lit("'s"))).drop("_txt", "_rep")
