import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from cohortspark.operators import bootstrap as BS
from cohortspark.plans import fixture as FX
from cohortspark.streaming import flags as SF


def test_flag_stream_matches_batch(spark, tmp_path):
    src = f"{SF_SMALL}/documents*.parquet"
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    stream = SF.read_report_stream(spark, src, schema)
    flagged = SF.flag_stream(stream, FX.vocab_df(spark)).select("doc_id", "pred_a", "pred_b")
    q = flagged.writeStream.format("memory").queryName("flags_stream_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: (r.pred_a, r.pred_b) for r in spark.sql("SELECT * FROM flags_stream_test").collect()}
    batch = SF.flag_stream(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), FX.vocab_df(spark))
    want = {r.doc_id: (r.pred_a, r.pred_b) for r in batch.select("doc_id", "pred_a", "pred_b").collect()}
    assert got == want and len(got) > 0


def _row_bootstrap(tp, fp, fn, tn, n_boot, seed):
    rng = np.random.default_rng(seed)
    y = np.array([1] * (tp + fn) + [0] * (tn + fp))
    p = np.array([1] * tp + [0] * fn + [0] * tn + [1] * fp)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    out = []
    for _ in range(n_boot):
        idx = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        yy, pp = y[idx], p[idx]
        t = int(((yy == 1) & (pp == 1)).sum())
        f_p = int(((yy == 0) & (pp == 1)).sum())
        f_n = int(((yy == 1) & (pp == 0)).sum())
        out.append(2 * t / (2 * t + f_p + f_n) if (2 * t + f_p + f_n) else 0.0)
    return np.percentile(out, [2.5, 97.5])


def test_bootstrap_matches_row_resampling(spark):
    counts = spark.createDataFrame([("a", 30, 12, 20, 140), ("b", 0, 0, 0, 10)], "k string, tp long, fp long, fn long, tn long")
    out = {(r.k, r.metric): r for r in BS.bootstrap_ci(counts, ["k"], ("f1", "mcc"), n_boot=2000, seed=3).collect()}
    lo, hi = _row_bootstrap(30, 12, 20, 140, 2000, 1)
    f1 = out[("a", "f1")]
    assert abs(f1.estimate - 60 / 92) < 1e-12
    assert abs(f1.lo - lo) < 0.03 and abs(f1.hi - hi) < 0.03
    assert f1.lo < f1.estimate < f1.hi
    assert out[("b", "f1")].lo is None and out[("b", "mcc")].hi is None  # single class -> no interval
    again = {(r.k, r.metric): r.lo for r in BS.bootstrap_ci(counts.repartition(3), ["k"], ("f1",), n_boot=2000, seed=3).collect()}
    assert again[("a", "f1")] == f1.lo  # deterministic, independent of partitioning


def test_bootstrap_pr_auc_interval(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(y * 0.3 + rng.random(400) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").withColumn("k", F.lit("x"))
    r = BS.bootstrap_pr_auc(df, ["k"], "y", "s", n_boot=200, seed=1).collect()[0]
    assert r.lo < r.estimate < r.hi
    # stratified row resampling for comparison
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    vals = []
    for _ in range(300):
        idx = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        yy, ss = y[idx], s[idx]
        order = np.argsort(-ss, kind="stable")
        yy, ss = yy[order], ss[order]
        P = yy.sum()
        ap, tp, n = 0.0, 0, 0
        i = 0
        while i < len(ss):
            j = i
            while j < len(ss) and ss[j] == ss[i]:
                j += 1
            p = yy[i:j].sum()
            tp += p
            n += j - i
            ap += p / P * tp / n
            i = j
        vals.append(ap)
    lo, hi = np.percentile(vals, [2.5, 97.5])
    assert abs(r.lo - lo) < 0.06 and abs(r.hi - hi) < 0.06


def test_pr_auc_blocks_draw_one_stratified_resample(spark):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    y = (rng.random(900) < 0.3).astype(int)
    s = np.round(y + rng.normal(0, 20, 900), 1)  # any real score, many distinct ones
    df = spark.createDataFrame([(int(a), float(b), "x" if i % 2 else "y") for i, (a, b) in enumerate(zip(y, s))], "y int, s double, k string")
    one, many = (
        {r.k: r for r in BS.bootstrap_pr_auc(df, ["k"], "y", "s", n_boot=400, seed=2, block=b).collect()} for b in (1 << 16, 50)
    )
    for k in ("x", "y"):
        assert one[k].lo < one[k].estimate < one[k].hi
        assert abs(one[k].lo - many[k].lo) < 0.03 and abs(one[k].hi - many[k].hi) < 0.03
    blocks = pa.table({"k": ["x"] * 3, "block": [2, 0, 1], "pos": [5, 7, 0], "neg": [1, 0, 9]})
    out = BS._split_draws(blocks, ["k"], 200, 0)
    for name, total in (("pos", 12), ("neg", 10)):
        draws = np.array([np.frombuffer(d, "<i8") for d in out.column(f"{name}_draw").to_pylist()])
        assert (draws.sum(axis=0) == total).all() and draws.std() > 0  # class totals are fixed in every replicate
    single = spark.createDataFrame([(1, 0.5, "z")], "y int, s double, k string")
    assert BS.bootstrap_pr_auc(single, ["k"], "y", "s", n_boot=20).collect()[0].lo is None


def test_evaluation_row_has_every_field(spark):
    from cohortspark.operators import metrics as M

    rng = np.random.default_rng(1)
    rows = [("train", "letters", int(rng.random() < 0.4), int(rng.random() < 0.5), float(rng.random())) for _ in range(200)]
    df = spark.createDataFrame(rows, "split string, col string, gold int, pred int, prob double")
    out = M.evaluate_model(df, ["split", "col"], "gold", "pred", "prob", "rows", True, 100, dataset="split", report_col="col", pred_type="BOW")
    r = out.collect()[0].asDict()
    assert len(r) == 18 and r["Dataset"] == "train" and r["Gold_Standard_Column"] == "gold" and r["Coverage_Pct"] == "100.00%"
    assert all("(CI: " in r[c] and "N/A" not in r[c] for c in ("F1_Score", "MCC", "PR_AUC", "Accuracy"))
