from cohortspark.operators import explain as EX


def test_special_tokens_go_before_the_merge(spark):
    rows = [(1, 0, "[CLS]", 9.0), (1, 1, "bow", 0.5), (1, 2, "[PAD]", 9.0), (1, 3, "##el", 0.25), (1, 4, "scan", -0.5), (1, 5, "of", 3.0), (1, 6, "[SEP]", 9.0)]
    words = EX.merge_subwords(spark.createDataFrame(rows, "doc int, pos int, token string, score double"))
    assert [(r["word"], r["score"]) for r in words.orderBy("word_id").collect()] == [("bowel", 0.75), ("scan", -0.5), ("of", 3.0)]
    assert EX.top_tokens(words).collect()[0]["top_tokens"] == "bowel(+0.75) | scan(-0.50)"
