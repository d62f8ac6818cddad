"""Mean word vectors: vectors of (document, word) rows cross no shuffle; both ways of meeting the vectors agree."""

import re

from cohortspark.operators import features as FE


def test_vectors_cross_no_shuffle(spark, capsys, monkeypatch):
    rows = [(1, "aa bb aa"), (1, "cc"), (2, None), (None, "aa"), (3, "zz aa"), (4, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    vectors = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 2.0]), ("bb", [0.0, 1.0]), ("zz", None)], "word string, vector array<float>")
    out = FE.mean_vectors(df, "id", "t", vectors, 2)
    out.explain()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", capsys.readouterr().out)
    assert dealt and all(re.fullmatch(r"id#\w+, \d+", d) for d in dealt)
    pairs = lambda d: sorted((r.id or 0, tuple(round(v, 9) for v in r.vector)) for r in d.collect())
    got = pairs(out)
    # rows of one id share their sum, each divides by its own count; a null id is no document of another row
    assert [g for g in got if g[0] == 1] == [(1, (round(2 / 3, 9), 1.0)), (1, (2.0, 3.0))] and (0, (0.0, 0.0)) in got and (3, (0.5, 0.0)) in got
    monkeypatch.setattr(FE, "VECTOR_NUMBERS", 0)
    assert pairs(FE.mean_vectors(df, "id", "t", vectors, 2)) == got
