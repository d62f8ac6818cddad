from cohortspark.operators import fairness as FA


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, grp string, pred int, gold int")


def test_parity_difference(spark):
    rows = [("x", "A", p, 1) for p in [1, 1, 1, 0, 0]] + [("x", "B", p, 1) for p in [1, 0, 1, 0]]
    # A: 3/5 = 0.6, B: 2/4 = 0.5, reference B -> parity(A) = 0.1
    ref = spark.createDataFrame([("grp", "B")], "attribute string, ref_group string")
    df = _frame(spark, rows)
    out = {r.grp: r for r in FA.demographic_parity(df, ["k"], ["grp"], "pred", "gold", ref).collect()}
    assert abs(out["A"].demographic_parity - 0.1) < 1e-12 and out["B"].demographic_parity is None


def test_equal_opportunity(spark):
    # TPR A = 1/2, B = 2/3 -> |1/2 - 2/3| = 1/6 with reference A; no reference given -> first sorted (A)
    rows = [("x", "A", 1, 1), ("x", "A", 0, 1), ("x", "B", 1, 1), ("x", "B", 1, 1), ("x", "B", 0, 1), ("x", "C", 1, 0)]
    df = _frame(spark, rows)
    out = {r.grp: r for r in FA.equal_opportunity(df, ["k"], ["grp"], "pred", "gold", None).collect()}
    assert out["A"].eo_ref == "A"
    assert abs(out["B"].equal_opportunity - 1 / 6) < 1e-12
    assert out["C"].equal_opportunity is None  # no positives in C -> TPR null


def test_disparate_impact(spark):
    # rate A = 1/3, rate B = 1/2, reference B -> (1/3)/(1/2)
    rows = [("x", "A", p, 0) for p in [1, 0, 0]] + [("x", "B", p, 0) for p in [1, 0]]
    ref = spark.createDataFrame([("grp", "B")], "attribute string, ref_group string")
    out = {r.grp: r for r in FA.disparate_impact(_frame(spark, rows), ["k"], ["grp"], "pred", "gold", ref).collect()}
    assert abs(out["A"].disparate_impact - (1 / 3) / 0.5) < 1e-12
    missing = spark.createDataFrame([("grp", "Z")], "attribute string, ref_group string")
    out2 = FA.disparate_impact(_frame(spark, rows), ["k"], ["grp"], "pred", "gold", missing).collect()
    assert all(r.disparate_impact is None for r in out2)


def test_parity_fallback_and_report(spark):
    # reference rate 0 -> first sorted group with rate > 0
    rows = [("x", "A", 0, 0), ("x", "B", 1, 0), ("x", "C", 1, 1), ("x", "C", 0, 1)]
    ref = spark.createDataFrame([("grp", "A")], "attribute string, ref_group string")
    rep = FA.fairness_report(_frame(spark, rows), ["k"], ["grp"], "pred", "gold", ref)
    got = {(r.level, r.grp): r for r in rep.collect()}
    assert got[("group", "C")].dp_ref == "B" and abs(got[("group", "C")].demographic_parity - (-0.5)) < 1e-12
    assert got[("all", "all")].n == 4
    maps = FA.fairness_maps(rep, ["k"]).collect()[0]
    assert "Demographic_Parity_grp_Group_C_vs_B" in maps.Demographic_Parity
    long = FA.fairness_long(rep, ["k"]).collect()
    assert any(r.label == "C vs B" for r in long)


def test_fairness_f1_interval(spark):
    rows = [("x", g, p, y) for g in "AB" for p, y in [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1), (1, 1)] * 5]
    rep = FA.fairness_report(_frame(spark, rows), ["k"], ["grp"], "pred", "gold", None, f1_interval=True, n_boot=200)
    for r in rep.collect():
        assert r.f1_lo is not None and r.f1_lo <= r.f1 <= r.f1_hi
