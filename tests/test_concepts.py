import re

from conftest import SF_SMALL

from cohortspark.operators import concepts as CO
from cohortspark.plans import fixture as FX
from cohortspark.sources import readers as RD
from cohortspark.sources import testdata_view as TV


def _brute(text, terms):
    """Reference semantics: one alternation, more words first (stable by file order), whole words."""
    if text is None:
        return ""
    text = text.replace("‘", "'").replace("’", "'")
    pref = {}
    for alias, p, _ in sorted(terms, key=lambda t: t[2]):
        pref.setdefault(alias.lower(), p)
    order = sorted(pref, key=lambda a: len(a.split()), reverse=True)
    rx = re.compile(r"\b(?:" + "|".join(map(re.escape, order)) + r")\b", re.IGNORECASE)
    return rx.sub(lambda m: pref[m.group(0).lower()], text).replace("?s", "'s")


def test_standardise_matches_brute_force(spark):
    docs = TV.report_view(spark, SF_SMALL).select("doc_id", "text")
    out = CO.standardise_terms(docs, "doc_id", "text", FX.standard_terms_df(spark), out="std").collect()
    assert len(out) == docs.count()
    changed = 0
    for r in out:
        want = _brute(r.text, FX.STANDARD_TERMS)
        assert r.std == want, r.doc_id
        changed += r.std != (r.text or "")
    assert changed > 0


def test_standardise_overlaps(spark):
    terms = spark.createDataFrame([("bowel", "B", 1), ("inflammatory bowel disease", "IBD", 2), ("disease", "D", 3)], "alias string, preferred string, ord long")
    df = spark.createDataFrame([(1, "Inflammatory bowel disease and bowel disease?s"), (2, None)], "id int, t string")
    got = {r.id: r.s for r in CO.standardise_terms(df, "id", "t", terms, out="s").collect()}
    assert got == {1: "IBD and B D's", 2: ""}


def test_preferred_terms_and_lookup(spark):
    rows = [
        ("C1", "ENG", "P", "Y", "SY", "Colitis", 1),
        ("C1", "ENG", "P", "Y", "PT", "Colitis, ulcerative", 2),
        ("C1", "ENG", "S", "N", "PT", "UC", 3),
        ("C2", "ENG", "P", "Y", "PT", "Bowel", 4),
        ("C2", "ENG", "S", "N", "SY", "colitis", 5),
    ]
    c = spark.createDataFrame(rows, "CUI string, LAT string, TS string, ISPREF string, TTY string, STR string, ord long")
    cui_pref, term_pref = CO.preferred_terms(c)
    assert {r.CUI: r.preferred for r in cui_pref.collect()} == {"C1": "Colitis, ulcerative", "C2": "Bowel"}
    tp = {r.alias: r.preferred for r in term_pref.collect()}
    assert tp["colitis"] == "Bowel"  # last concept of the alias wins
    assert tp["uc"] == "Colitis, ulcerative"
    terms = spark.createDataFrame([(" COLITIS ",), ("nothing",)], "term string")
    lk = {r.term: r.cuis for r in CO.term_to_concepts(c, terms).collect()}
    assert lk == {" COLITIS ": ["C1", "C2"], "nothing": []}


def test_load_concepts_file(spark, tmp_path):
    p = tmp_path / "concepts.rrf"
    good = "|".join(["C0000001", "ENG", "P", "L", "PF", "S", "Y", "A", "", "", "", "SRC", "PT", "X", "Colitis", "0", "N", ""])
    short = "C0000002|ENG|P"
    p.write_text(good + "\n" + short + "\n" + good.replace("C0000001", "C0000003") + "\n")
    df = RD.load_concepts(spark, str(p))
    rows = df.orderBy("ord").collect()
    assert [r.CUI for r in rows] == ["C0000001", "C0000003"]
    assert rows[0].STR == "Colitis" and rows[0].TTY == "PT"


def test_standardise_ligatures_and_equal_aliases(spark):
    df = spark.createDataFrame([(1, "in\ufb02amed gut")], "id int, t string").repartition(2)
    terms = spark.createDataFrame([("inflamed", "second", 2), ("Inflamed", "first", 1)], "alias string, preferred string, ord int").repartition(2)
    assert CO.standardise_terms(df, "id", "t", terms, out="s").first().s == "first gut"
