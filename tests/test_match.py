from pyspark.sql import functions as F

from cohortspark import defaults
from cohortspark.operators import match as MT


def test_regex_flags(spark):
    vocab = spark.createDataFrame([("IBD", r"\bcolitis\b"), ("IBD", r"\bcrohn'?s\b"), ("Drug", r"\binfliximab\b")], "category string, pattern string")
    df = spark.createDataFrame([(1, "Ulcerative COLITIS noted"), (2, "crohns disease"), (3, "nothing here"), (4, None)], "id int, t string")
    out = MT.regex_flags(df, vocab, "t").orderBy("id").collect()
    assert [r.pred_ibd for r in out] == [1, 1, 0, 0]
    assert [r.pred_drug for r in out] == [0, 0, 0, 0]
    miss = MT.regex_flags(df, vocab, "absent_column").collect()
    assert all(r.pred_ibd == 0 for r in miss)


def test_whole_word_unicode(spark):
    vocab = spark.createDataFrame([("A", "colitis")], "category string, pattern string")
    df = spark.createDataFrame([(1, "äcolitis"), (2, "colitisß"), (3, "(colitis)"), (4, "Colitis")], "id int, t string")
    got = [r.pred_a for r in MT.regex_flags(df, vocab, "t", whole_word=True).orderBy("id").collect()]
    assert got == [0, 0, 1, 1]


def test_phrase_match_and_optional(spark):
    ph = spark.createDataFrame([("A", r"\bcrohn'?s\b"), ("A", "ulcerative colitis")], "category string, phrase string")
    df = spark.createDataFrame([(1, "Crohn's and crohns; ulcerative  colitis")], "id int, t string")
    m = MT.phrase_match(df, ["id"], "t", ph, "phrase").collect()
    keys = sorted(r.key for r in m)
    assert keys == ["crohn ' s", "crohns", "ulcerative colitis"]


def test_negation_rules(spark):
    cues = defaults.negation_terms_df(spark)
    ph = spark.createDataFrame([("A", "colitis")], "category string, phrase string")
    texts = [
        (1, "not colitis"),                 # preceding cue -> negated
        (2, "colitis not"),                 # preceding cue after the match -> not negated
        (3, "no evidence of colitis"),      # starts inside pseudo 'no' -> cue void -> not negated
        (4, "not here. colitis"),           # other sentence -> not negated
        (5, "colitis no signs of"),         # following cue void (starts at pseudo 'no') -> not negated
        (6, "without colitis"),             # 'without' is pseudo and preceding -> pseudo wins
    ]
    df = spark.createDataFrame(texts, "id int, t string")
    m = {r.id: r.negated for r in MT.negated_match(df, ["id"], "t", ph, cues).collect()}
    assert m == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    off = MT.negated_match(df, ["id"], "t", ph, cues, scope="off").collect()
    assert len(off) == 6 and not any(r.negated for r in off)


def test_negation_following(spark):
    cues = spark.createDataFrame([("following", "ruled out"), ("preceding", "denies")], "kind string, phrase string")
    ph = spark.createDataFrame([("A", "colitis")], "category string, phrase string")
    df = spark.createDataFrame([(1, "colitis ruled out"), (2, "denies colitis"), (3, "colitis")], "id int, t string")
    m = {r.id: r.negated for r in MT.negated_match(df, ["id"], "t", ph, cues).collect()}
    assert m == {1: True, 2: True, 3: False}
    flags = {r.id: r.pred_a for r in MT.phrase_flags(df, ["id"], MT.negated_match(df, ["id"], "t", ph, cues), ["A"]).collect()}
    assert flags == {1: 0, 2: 0, 3: 1}


def test_normalise_text(spark):
    df = spark.createDataFrame([("ﬁne Crohn’s",)], "t string")
    assert df.select(MT.normalise_text("t").alias("n")).collect()[0].n == "fine Crohn's"


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, "no colitis seen")], "id int, t string")
    none = spark.createDataFrame([], "category string, phrase string")
    cues = spark.createDataFrame([], "kind string, phrase string")
    out = MT.negated_match(df, ["id"], "t", none, cues)
    assert out.collect() == [] and {"id", "seg", "start", "end", "category", "phrase", "negated"} <= set(out.columns)


def _negated_by_hand(text, targets, cues):
    """(phrase, segment, start, end, negated) of one text, straight from the rules: every pair, no sweep."""
    import regex

    ends = [m.start() for m in regex.finditer(r"[;!?]|\.(?![0-9])|(?<![0-9])\.", text)]
    spans = [(m.group().lower(), m.start()) for m in regex.finditer(MT.PHRASE_TOKEN, text)]
    tokens = [t for t, _ in spans]
    raw = [sum(e < at for e in ends) for _, at in spans]  # segment of every token; a mark belongs to the one it ends
    cut = lambda p: regex.findall(MT.PHRASE_TOKEN, p.lower())
    hits = [
        (kind, p, i, i + len(cut(p)))
        for kind, p in [("target", t) for t in targets] + cues
        for i in range(len(tokens) - len(cut(p)) + 1) if tokens[i : i + len(cut(p))] == cut(p)
    ]
    joined = {s for _, _, a, b in hits for s in range(raw[a], raw[b - 1])}  # marks after these segments are inside a phrase
    def scope(s):
        while s - 1 in joined:
            s -= 1
        return s
    at = [scope(s) for s in raw]
    live = [h for h in hits if h[0] in ("preceding", "following") and not any(
        p[0] == "pseudo" and at[p[2]] == at[h[2]] and p[2] <= h[2] <= p[3] for p in hits)]
    out = []
    for kind, p, a, b in hits:
        if kind == "target":
            same = [h for h in live if at[h[2]] == at[a]]
            neg = any(h[0] == "preceding" and h[2] < a or h[0] == "following" and h[3] > b for h in same)
            base = next(i for i, s in enumerate(raw) if s == at[a])
            out.append((p, at[a], a - base, b - base, neg))
    return out


def test_negation_equals_the_rules_pair_by_pair(spark):
    import random

    rng = random.Random(11)
    targets = ["st. john's wort", "colitis", "grade 1.5", "a; b", "b", "wort"]
    cues = [("pseudo", "no a"), ("pseudo", "no"), ("preceding", "not"), ("preceding", "no sign"), ("following", "no. of"), ("following", "out")]
    words = ["St.", "St. John's", "wort", "colitis", "grade", "1.5", "2.", "1.5.3", ".5", "a;", "a", "b", "no", "not", "no.", "of", "out", "sign", ".", "!", "x?", "é."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [".colitis not", "not 3.5 colitis", "not 3. 5 colitis", "not St. John's wort", None, "", " .. ", "a; b; not b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    ph = spark.createDataFrame([("A", p) for p in targets], "category string, phrase string")
    got = MT.negated_match(df, ["id"], "t", ph, spark.createDataFrame(cues, "kind string, phrase string")).collect()
    want = [(i, *h) for i, t in enumerate(texts) for h in _negated_by_hand(t or "", targets, cues)]
    assert sorted((r.id, r.phrase, r.seg, r.start, r.end, r.negated) for r in got) == sorted(want)
    assert any(h[1] == "st. john's wort" and h[5] for h in want) and any(h[1] == "st. john's wort" and not h[5] for h in want)
    by = {(r.id, r.phrase): r.negated for r in got}
    assert (by[151, "colitis"], by[152, "colitis"], by[153, "st. john's wort"]) == (True, False, True)


def test_negation_is_one_shuffle(spark):
    df = spark.createDataFrame([(1, "no colitis")], "id int, t string")
    ph = spark.createDataFrame([("A", "colitis")], "category string, phrase string")
    m = MT.negated_match(df, ["id"], "t", ph, defaults.negation_terms_df(spark))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and "InMemory" not in plan


def test_literals_one_by_one_are_the_alternation(spark):
    """Slow alternations behind a boundary are looked for literal by literal, with the same hits."""
    import re

    from cohortspark.functions import text as tx

    words = ["mask", "is", "mit license", "x_1"]
    parts = ["mask", "MAS\u212a", "ma\u017fk", "\u0130s", "\u0131S", "is", "x_1", "mit  license", "MIT License", "\u00e9", "_", "-", ".", "\n", " ", "\U0001d400", "7"]
    rows = [a + b + c for a in parts for b in parts for c in parts] + ["", None, "mask\n", "\nmask"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    for whole in (True, False):
        plain = tx.whole_word(words) if whole else tx.any_of(words)
        got = df.select("i", F.coalesce(tx.holds(F.col("t"), words, whole), F.lit(False)).alias("a"), F.coalesce(F.col("t").rlike(plain), F.lit(False)).alias("b"))
        assert got.filter("a <> b").collect() == [] and got.filter("a").count() > 0
        plan = df.select(tx.holds(F.col("t"), words, whole))._jdf.queryExecution().optimizedPlan().toString()
        assert "|" not in re.sub(r"\[[^]]*\]", "", plan.split("RLIKE")[1])


def test_texts_without_a_target_are_not_cut_into_tokens(spark):
    df = spark.createDataFrame([(1, "the mask or"), (2, "the or and"), (3, "MAS\u212a x"), (4, None), (5, "unmasked")], "doc_id long, text string")
    targets = spark.createDataFrame([("A", "mask")], "category string, phrase string")
    cues = spark.createDataFrame([("preceding", "the")], "kind string, phrase string")
    got = MT.negated_match(df, ["doc_id"], "text", targets, cues)
    assert sorted((r["doc_id"], r["negated"]) for r in got.collect()) == [(1, True), (3, False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RLIKE")
