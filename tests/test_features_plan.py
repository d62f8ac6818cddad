"""Term counts are dealt by id: (id, term) rows never cross a shuffle as such, and null ids have no TF-IDF row."""

import re

from cohortspark.operators import features as FE


def test_counts_move_documents_not_terms(spark, capsys):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, None), (None, "aa dd"), (3, "dd aa")], "doc_id long, text string")
    tf = FE.bow_features(docs, "doc_id", "text", 2)
    tf.explain()
    assert len(re.findall(r"Exchange hashpartitioning", capsys.readouterr().out)) == 1
    assert {(r.doc_id, r.term): r.tf for r in tf.collect()} == {
        (1, "aa"): 2, (1, "bb"): 2, (1, "cc"): 1, (1, "aa bb"): 1, (1, "bb aa"): 1, (1, "bb cc"): 1,
        (None, "aa"): 1, (None, "dd"): 1, (None, "aa dd"): 1, (3, "dd"): 1, (3, "aa"): 1, (3, "dd aa"): 1,
    }
    weights = FE.tfidf_features(tf, "doc_id")
    weights.explain()
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\w+, term#", capsys.readouterr().out)
    norm: dict = {}
    for r in weights.collect():
        norm[r.doc_id] = norm.get(r.doc_id, 0.0) + r.weight**2
    assert sorted(norm) == [1, 3] and all(abs(v - 1) < 1e-9 for v in norm.values())
