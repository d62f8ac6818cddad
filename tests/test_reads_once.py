"""Texts are read and dealt once, whatever the number of steps behind them."""

import numpy as np

from cohortspark.llm.langid import Centroids
from cohortspark.operators import explain as EX
from cohortspark.operators import study as ST
from cohortspark.sources import testdata_view as TV


def test_flag_patterns_are_saved(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i % 2, (i // 2) % 2, int(i % 5 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, y int").mapInArrow(count, "a int, b int, y int")
    found = ST.odds_ratios(df, ["a", "b"], "y")
    assert found.count() == 6
    assert seen.value == 40, seen.value  # the fits read the patterns


def test_patterns_weights(spark):
    rows = [(1, 0, 1), (1, 0, 1), (0, None, 1), (0, 0, 0)]
    got = ST.flag_patterns(spark.createDataFrame(rows, "a int, b int, y int"), ["a", "b"], "y")
    assert {tuple(r) for r in got.collect()} == {(1.0, 0.0, 1.0, 2.0), (0.0, 0.0, 0.0, 1.0)}


def test_pieces_cross_one_shuffle(spark, tmp_path):
    rows = [(1, "alphabet of Words"), (2, None), (2, "twice"), (2, "seen"), (None, "no id here")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = EX.merge_subwords(TV.token_scores(spark, str(tmp_path)), "doc", "pos")
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    got = sorted(r["word"] for r in words.filter("doc = 1").collect())
    assert got == ["alphabet", "of", "words"]


def test_centroids_in_the_place_of_counts():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (700, 4096)).astype(np.float32)
    langs = ["de"] * 300 + ["en"] * 400
    kept = counts.copy()
    a = Centroids.fit(counts, langs, 3, 4, 0.5)
    assert (counts == kept).all()
    b = Centroids.fit(kept, langs, 3, 4, 0.5, spare=True)
    assert (a.centres == b.centres).all() and (a.idf == b.idf).all() and a.least == b.least
