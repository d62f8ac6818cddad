"""Terms counted in batches: the counts of the plain way, and no shuffle of texts or counts."""

import collections
import re

import pyarrow as pa

from cohortspark.operators import features as FE


def _plain(rows, n_max):
    out = collections.Counter()
    for i, text in rows:
        t = re.findall(r"\w{2,}", (text or "").lower())
        out.update((i, " ".join(t[k : k + n])) for n in range(1, n_max + 1) for k in range(len(t) - n + 1))
    return dict(out)


def _rows():
    return [(1, "Aa bb aa bb"), (2, None), (3, ""), (4, "x dd"), (None, "aa dd ee dd"), (6, "dd " * 40), (7, "\u00c4\u00e4 \u4e2d\u6587 a_1 aa-bb")]


def test_rows_without_repeated_ids(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string").repartition(2)
    for n in (1, 2, 3):
        tf = FE.bow_features(df, "doc_id", "text", n)
        assert {(r.doc_id, r.term): r.tf for r in tf.collect()} == _plain(_rows(), n)
        plan = tf._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "hashpartitioning" not in plan
    again = df.unionByName(df)
    want = {k: 2 * v for k, v in _plain(_rows(), 2).items()}
    assert {(r.doc_id, r.term): r.tf for r in FE.bow_features(again, "doc_id", "text", 2).collect()} == want


def test_common_terms_go_and_kept_columns_stay(spark):
    rows = [(i, f"all w{i} " + ("most " if i else ""), i % 3) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    tf = FE.bow_features(df, "doc_id", "text", 1, 0.9, also=["fold"])
    assert tf.columns == ["doc_id", "fold", "term", "tf"]
    assert sorted(tuple(r) for r in tf.collect()) == sorted([(i, i % 3, f"w{i}", 1) for i in range(8)] + [(i, i % 3, "most", 1) for i in range(1, 8)])


def test_slices_keep_every_row():
    tokens = pa.array([["a"] * k for k in range(30)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), tokens], names=["i", "t"])
    parts = list(FE._slices(iter([batch]), 100))
    assert len(parts) > 3 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(30))
    got = {(r["i"], r["term"]): r["tf"] for p in FE.count_terms(iter(parts), 2) for r in p.to_pylist()}
    assert got == {(k, "a"): k for k in range(1, 30)} | {(k, "a a"): k - 1 for k in range(2, 30)}
