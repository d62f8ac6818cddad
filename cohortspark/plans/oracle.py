"""DuckDB oracle SQL for the registered queries.

Independent formulations of the same results, written directly in SQL over the
driver's tables; they share only the fixed parameters (view definition,
vocabularies).  Doubles are rounded to 6 places on both sides; counts are BIGINT.
"""

from __future__ import annotations

from statistics import NormalDist

from cohortspark import defaults
from cohortspark.plans import fixture as FX
from cohortspark.sources import testdata_view as TV

Z = NormalDist().inv_cdf(0.975)
W = r"\p{L}\p{N}_"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _slot_case(x: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(TV.REPORT_SLOTS))
    return f"CASE {x} % 4 {whens} END"


def _eth_case(src: str) -> str:
    k = len(TV.RAW_ETHNICITY)
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(TV.RAW_ETHNICITY) if v is not None)
    return f"CASE CAST(regexp_extract({src}, '(\\d+)$', 1) AS INTEGER) % {k} {whens} ELSE NULL END"


REPORTS_CTE = f"""reports AS (
  SELECT d.doc_id AS doc_id,
         d.doc_id // 12 AS study_id,
         (d.doc_id // 4) % 3 AS visit_id,
         {_slot_case('d.doc_id')} AS report_col,
         d.doc_id AS ord,
         CASE WHEN d.doc_id % 17 <> 0 THEN d.text END AS text,
         CAST(l.quality AS INTEGER) AS gold,
         CAST(l.toxic AS INTEGER) AS gold_alt,
         d.lang AS gender,
         {_eth_case('d.source')} AS ethnicity_raw,
         d.n_chars % 110 AS age,
         (d.doc_id // 12) % 12 AS imd,
         CASE WHEN (d.doc_id // 12) % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN d.doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split_leaky
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

_ETH_VALUES = ", ".join(f"({q(a)}, {q(b)})" for a, b in defaults.ETHNICITY_GROUPS)
_IMD_CASE = "CASE " + " ".join(
    f"WHEN imd {'>=' if i == 0 else '>'} {lo} AND imd <= {hi} THEN {q(lab)}" for i, (lo, hi, lab) in enumerate(defaults.IMD_BINS)
) + " END"
_AGE_CASE = (
    "CASE WHEN age >= 0 AND age < 100 THEN CAST(CAST(floor(age / 10) * 10 AS BIGINT) AS VARCHAR) || '-' || "
    "CAST(CAST(floor(age / 10) * 10 + 10 AS BIGINT) AS VARCHAR) END"
)

PREPARED_CTE = f"""{REPORTS_CTE},
ethmap(raw, grp) AS (VALUES {_ETH_VALUES}),
prepared AS (
  SELECT r.*, COALESCE(m.grp, {q(defaults.ETHNICITY_DEFAULT)}) AS ethnicity,
         {_AGE_CASE} AS age_group, {_IMD_CASE} AS imd_group
  FROM reports r LEFT JOIN ethmap m ON lower(r.ethnicity_raw) = m.raw
)"""


def whole_word_re(alts: list[str]) -> str:
    body = "|".join(f"(?:{a})" for a in alts)
    return f"(?i)(^|[^{W}])(?:{body})([^{W}]|$)"


def regex_flag_sql(col: str, alts: list[str]) -> str:
    return f"CAST(COALESCE(regexp_matches({col}, {q(whole_word_re(alts))}), false) AS INTEGER)"


def vocab_patterns() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c, p in FX.VOCAB:
        out.setdefault(c, []).append(p)
    return out


def flagged_cte(src: str = "prepared") -> str:
    pats = vocab_patterns()
    cats = sorted(pats)
    flags = ", ".join(f"{regex_flag_sql('text', pats[c])} AS pred_{c.lower()}" for c in cats)
    comb = "GREATEST(" + ", ".join(f"pred_{c.lower()}" for c in cats) + ")"
    return f"""flagged0 AS (SELECT *, {flags} FROM {src}),
flagged AS (SELECT *, {comb} AS pred, CAST({comb} AS DOUBLE) AS prob FROM flagged0)"""


def levels_cte(label: str = FX.LABEL, pred_type: str = "Combined_Regex", demo: list[str] = ()) -> str:
    d = "".join(f", {x}" for x in demo)
    dfirst = "".join(f", arg_min({x}, CASE WHEN {x} IS NOT NULL THEN ord END) AS {x}" for x in demo)
    return f"""docs AS (
  SELECT split AS dataset, study_id, visit_id, report_col, ord, {label} AS gold, CAST(pred AS INTEGER) AS pred,
         CAST(prob AS DOUBLE) AS prob, 'document' AS level, {q(pred_type)} AS pred_type{d} FROM flagged),
visits AS (
  SELECT dataset, study_id, visit_id, CAST(COALESCE(MAX(pred), 0) AS INTEGER) AS pred,
         CAST(COALESCE(MAX(prob), 0.0) AS DOUBLE) AS prob, CAST(COALESCE(MAX(gold), 0) AS INTEGER) AS gold,
         'visit' AS level, 'cumulative' AS report_col, {q(pred_type)} AS pred_type
  FROM docs GROUP BY dataset, study_id, visit_id),
patients AS (
  SELECT dataset, study_id, MAX(COALESCE(pred, 0)) AS pred, MAX(COALESCE(prob, 0.0)) AS prob,
         MAX(COALESCE(gold, 0)) AS gold{dfirst}, 'patient' AS level, 'final' AS report_col, {q(pred_type)} AS pred_type
  FROM docs GROUP BY dataset, study_id),
alllevels AS (
  SELECT dataset, level, report_col, pred_type, gold, pred, prob FROM docs
  UNION ALL SELECT dataset, level, report_col, pred_type, gold, pred, prob FROM visits
  UNION ALL SELECT dataset, level, report_col, pred_type, gold, pred, prob FROM patients)"""


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def _ratio(a: str, b: str, zero: str | None = None) -> str:
    z = f" ELSE {zero}" if zero is not None else ""
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE){z} END"


def _wilson(k: str, n: str) -> tuple[str, str]:
    p = f"(CAST({k} AS DOUBLE) / CAST({n} AS DOUBLE))"
    nn = f"CAST({n} AS DOUBLE)"
    z2 = Z * Z
    den = f"(1.0 + {z2!r} / {nn})"
    center = f"(({p} + {z2!r} / (2.0 * {nn})) / {den})"
    margin = f"({Z!r} * sqrt({p} * (1.0 - {p}) / {nn} + {z2!r} / (4.0 * {nn} * {nn})) / {den})"
    return (
        f"CASE WHEN {n} > 0 THEN GREATEST(0.0, {center} - {margin}) END",
        f"CASE WHEN {n} > 0 THEN LEAST(1.0, {center} + {margin}) END",
    )


def metric_selects(zero_division: str = "report") -> list[str]:
    sn = "0.0" if zero_division == "zero" else None
    out = [
        f"{r6(_ratio('tp + tn', 'n'))} AS accuracy",
        f"{r6(_ratio('tp', 'tp + fp', '0.0'))} AS precision",
        f"{r6(_ratio('tp', 'tp + fn', '0.0'))} AS recall",
        f"{r6(_ratio('tn', 'tn + fp', sn))} AS specificity",
        f"{r6(_ratio('tn', 'tn + fn', sn))} AS npv",
        f"{r6('CASE WHEN 2*tp + fp + fn > 0 THEN 2.0 * tp / (2*tp + fp + fn) ELSE 0.0 END')} AS f1",
        r6("CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn) / "
           "sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0.0 END") + " AS mcc",
    ]
    for name, k, n in [
        ("accuracy", "tp + tn", "n"), ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"),
        ("specificity", "tn", "tn + fp"), ("npv", "tn", "tn + fn"),
    ]:
        lo, hi = _wilson(k, n)
        out += [f"{r6(lo)} AS {name}_lo", f"{r6(hi)} AS {name}_hi"]
    return out


def _bin_sql(s: str, bins: int = 10) -> str:
    step = 1.0 / bins
    return "(" + " + ".join(f"CASE WHEN {s} > CAST({q(repr(k * step))} AS DOUBLE) THEN 1 ELSE 0 END" for k in range(1, bins)) + ")"


def evaluate_sql(src: str, keys: list[str]) -> str:
    """CTE chain computing the evaluation rows of ``src`` (keys, gold, pred, prob) -> relation ``evaluation``."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = a.{x}" for x in keys)
    on_e = " AND ".join(f"c.{x} = e.{x}" for x in keys)
    return f"""h AS (SELECT {k}, CAST(gold AS INTEGER) AS y, CAST(pred AS INTEGER) AS yhat, CAST(prob AS DOUBLE) AS s
       FROM {src} WHERE gold IS NOT NULL AND pred IS NOT NULL AND prob IS NOT NULL),
cnt AS (SELECT {k}, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(SUM(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(SUM(CASE WHEN y = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN y = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       AVG((s - y) * (s - y)) AS brier0 FROM h GROUP BY {k}),
ps AS (SELECT {k}, s, SUM(y) AS pos, COUNT(*) AS m FROM h GROUP BY {k}, s),
cum AS (SELECT {k}, pos, SUM(pos) OVER (PARTITION BY {k} ORDER BY s DESC) AS cpos,
       SUM(m) OVER (PARTITION BY {k} ORDER BY s DESC) AS cm, SUM(pos) OVER (PARTITION BY {k}) AS p_all FROM ps),
ap AS (SELECT {k}, SUM(CAST(pos AS DOUBLE) / p_all * (CAST(cpos AS DOUBLE) / cm)) AS pr_auc0 FROM cum GROUP BY {k}),
bins AS (SELECT {k}, {_bin_sql('s')} AS b, COUNT(*) AS bn, AVG(y) AS fpos, AVG(s) AS ms FROM h GROUP BY ALL),
ece AS (SELECT {k}, SUM(ABS(fpos - ms) * bn) / SUM(bn) AS ece0 FROM bins GROUP BY {k}),
evaluation AS (
  SELECT c.*, {', '.join(metric_selects())},
         {r6('CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN a.pr_auc0 END')} AS pr_auc,
         {r6('CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN c.brier0 END')} AS brier,
         {r6('CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN e.ece0 END')} AS ece
  FROM cnt c LEFT JOIN ap a ON {on} LEFT JOIN ece e ON {on_e})"""


EVAL_OUT = (
    "n, tp, fp, fn, tn, accuracy, precision, recall, specificity, npv, f1, mcc, accuracy_lo, accuracy_hi, "
    "precision_lo, precision_hi, recall_lo, recall_hi, specificity_lo, specificity_hi, npv_lo, npv_hi, pr_auc, brier, ece"
)


def fairness_sql(src: str, keys: list[str], attrs: list[str], refs: list[tuple[str, str]]) -> str:
    """CTE chain -> relation ``fairness`` with group rows and 'all' rows of ``src`` (keys, pred, gold, attrs)."""
    k = ", ".join(keys)
    unp = " UNION ALL ".join(
        f"SELECT {k}, {q(a)} AS attribute, CAST({a} AS VARCHAR) AS grp, pred, gold FROM {src}" for a in attrs
    )
    rv = ", ".join(f"({q(a)}, {q(g)})" for a, g in refs)
    part = f"PARTITION BY {k}, attribute"
    cnt = lambda c: f"CAST(SUM(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""unp AS ({unp}),
gc AS (SELECT {k}, attribute, grp, CAST(COUNT(*) AS BIGINT) AS n, {cnt('gold = 1 AND pred = 1')} AS tp,
       {cnt('gold = 0 AND pred = 1')} AS fp, {cnt('gold = 1 AND pred = 0')} AS fn, {cnt('gold = 0 AND pred = 0')} AS tn
       FROM unp WHERE grp IS NOT NULL AND pred IS NOT NULL AND gold IS NOT NULL GROUP BY {k}, attribute, grp),
gr0 AS (SELECT *, {_ratio('tp + fp', 'n')} AS rate, {_ratio('tp', 'tp + fn')} AS tpr FROM gc),
refs(attribute, ref_group) AS (VALUES {rv}),
gr AS (SELECT gr0.*, rf.ref_group FROM gr0 LEFT JOIN refs rf ON gr0.attribute = rf.attribute),
g3 AS (SELECT gr.*, COUNT(*) OVER ({part}) AS ngroups,
       COALESCE(MAX(CASE WHEN grp = ref_group AND rate > 0 THEN grp END) OVER ({part}),
                MIN(CASE WHEN rate > 0 THEN grp END) OVER ({part})) AS dp_ref0,
       COALESCE(MAX(CASE WHEN grp = ref_group THEN grp END) OVER ({part}), MIN(grp) OVER ({part})) AS eo_ref,
       MAX(CASE WHEN grp = ref_group THEN grp END) OVER ({part}) AS di_ref
       FROM gr),
g4 AS (SELECT *, MAX(CASE WHEN grp = dp_ref0 THEN rate END) OVER ({part}) AS dp_rate,
       MAX(CASE WHEN grp = eo_ref THEN tpr END) OVER ({part}) AS eo_tpr,
       MAX(CASE WHEN grp = di_ref THEN rate END) OVER ({part}) AS di_rate FROM g3),
grp_rows AS (SELECT {k}, attribute, 'group' AS level, grp, n, tp, fp, fn, tn, rate, tpr,
       CASE WHEN ngroups >= 2 THEN dp_ref0 END AS dp_ref,
       CASE WHEN ngroups >= 2 AND dp_ref0 IS NOT NULL AND grp <> dp_ref0 THEN rate - dp_rate END AS demographic_parity,
       eo_ref, CASE WHEN grp <> eo_ref THEN abs(tpr - eo_tpr) END AS equal_opportunity,
       di_ref, CASE WHEN di_ref IS NOT NULL AND grp <> di_ref AND di_rate > 0 THEN rate / di_rate END AS disparate_impact
       FROM g4),
all_rows AS (SELECT {k}, attribute, 'all' AS level, 'all' AS grp, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(tp) AS BIGINT) AS tp,
       CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn, CAST(SUM(tn) AS BIGINT) AS tn,
       {_ratio('SUM(tp) + SUM(fp)', 'SUM(n)')} AS rate, {_ratio('SUM(tp)', 'SUM(tp) + SUM(fn)')} AS tpr,
       CAST(NULL AS VARCHAR) AS dp_ref, CAST(NULL AS DOUBLE) AS demographic_parity, CAST(NULL AS VARCHAR) AS eo_ref,
       CAST(NULL AS DOUBLE) AS equal_opportunity, CAST(NULL AS VARCHAR) AS di_ref, CAST(NULL AS DOUBLE) AS disparate_impact
       FROM gc GROUP BY {k}, attribute),
both_rows AS (SELECT * FROM grp_rows UNION ALL SELECT * FROM all_rows),
fairness AS (SELECT {k}, attribute, level, grp, n, tp, fp, fn, tn, {r6('rate')} AS rate, {r6('tpr')} AS tpr, dp_ref,
       {r6('demographic_parity')} AS demographic_parity, eo_ref, {r6('equal_opportunity')} AS equal_opportunity, di_ref,
       {r6('disparate_impact')} AS disparate_impact, {', '.join(metric_selects('zero'))} FROM both_rows)"""


PHRASE_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"
SCOPE_SPLIT = r"[.;!?]"
# Decimal points, which end no scope, are hidden while the text is cut (twice: 1.2.3 has two that share a digit).
DECIMAL = r"([0-9])\.([0-9])"


def ngram_sql(src: str, ids: list[str], text: str, lengths: list[int], scoped: bool) -> str:
    """Subquery of (ids, seg, start, n_words, key) for every token n-gram of the given lengths."""
    i = ", ".join(ids)
    hide = lambda t: f"regexp_replace({t}, {q(DECIMAL)}, '\\1' || chr(1) || '\\2', 'g')"
    hidden = hide(hide(f"COALESCE({text}, '')"))
    segs = f"string_split_regex({hidden}, {q(SCOPE_SPLIT)})" if scoped else f"[COALESCE({text}, '')]"
    s1 = f"SELECT {i}, unnest({segs}) AS seg_text, unnest(range(0, len({segs}))) AS seg FROM {src}"
    s2 = f"SELECT {i}, seg, regexp_extract_all(lower(replace(seg_text, chr(1), '.')), {q(PHRASE_TOKEN)}) AS t FROM ({s1})"
    parts = [
        f"SELECT {i}, seg, st AS start, {k} AS n_words, array_to_string(t[st + 1:st + {k}], ' ') AS key "
        f"FROM (SELECT {i}, seg, t, unnest(range(0, len(t) - {k} + 1)) AS st FROM ({s2}))"
        for k in lengths
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def phrase_values(rows: list[tuple[str, str]], cols: tuple[str, str]) -> str:
    vals = ", ".join(f"({q(a)}, {q(b)})" for a, b in rows)
    return (
        f"(SELECT {cols[0]}, phrase, array_to_string(regexp_extract_all(lower(phrase), {q(PHRASE_TOKEN)}), ' ') AS key, "
        f"len(regexp_extract_all(lower(phrase), {q(PHRASE_TOKEN)})) AS n_words FROM (VALUES {vals}) v({cols[0]}, phrase))"
    )


def _lens(rows) -> list[int]:
    import regex

    return sorted({len(regex.findall(PHRASE_TOKEN, p.lower())) for _, p in rows})


def phrase_match_sql(src: str, ids: list[str], text: str, rows, col: str, scoped: bool) -> str:
    g = ngram_sql(src, ids, text, _lens(rows), scoped)
    gi = ", ".join(f"g.{x}" for x in ids)
    return (
        f"(SELECT {gi}, g.seg, g.start, g.start + g.n_words AS \"end\", g.n_words, g.key, p.{col}, p.phrase "
        f"FROM {g} g JOIN {phrase_values(rows, (col, 'phrase'))} p ON g.key = p.key AND g.n_words = p.n_words)"
    )


def negation_sql(src: str, ids: list[str], text: str, targets, cues) -> str:
    """CTE chain -> relation ``negm`` (target matches with ``negated``)."""
    i = ", ".join(ids)
    on = " AND ".join(f"c.{x} = m.{x}" for x in ids)
    on2 = " AND ".join(f"t.{x} = s.{x}" for x in ids)
    return f"""tm AS {phrase_match_sql(src, ids, text, targets, 'category', True)},
cm AS {phrase_match_sql(src, ids, text, cues, 'kind', True)},
covered AS (SELECT DISTINCT {i}, seg, unnest(range(start, "end" + 1)) AS pos FROM cm WHERE kind = 'pseudo'),
live AS (SELECT * FROM cm m WHERE kind IN ('preceding', 'following') AND NOT EXISTS
         (SELECT 1 FROM covered c WHERE {on} AND c.seg = m.seg AND c.pos = m.start)),
sc AS (SELECT {i}, seg, MIN(CASE WHEN kind = 'preceding' THEN start END) AS fp,
       MAX(CASE WHEN kind = 'following' THEN "end" END) AS lf FROM live GROUP BY {i}, seg),
negm AS (SELECT t.*, (COALESCE(s.fp < t.start, false) OR COALESCE(s.lf > t."end", false)) AS negated
         FROM tm t LEFT JOIN sc s ON {on2} AND t.seg = s.seg)"""
