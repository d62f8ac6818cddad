from cohortspark.operators import responses as RS


def test_repair_statuses(spark):
    rows = [
        (1, '{"Likelihood of IBD": 7, "Features": ["a", "b"], "Title": "t"}'),
        (2, '{"Likelihood of IBD": 3,}'),
        (3, 'Sure! {"Likelihood of IBD": "8"} hope this helps'),
        (4, '{"Likelihood of IBD": 9 // very likely\n}'),
        (5, '{"Likelihood of IBD": 9'),
        (6, "5"),
        (7, None),
        (8, '{"Likelihood of IBD": "high"}'),
    ]
    df = spark.createDataFrame(rows, "id int, js string")
    out = {r.id: r for r in RS.parse_response(RS.repair_json(df, "js")).collect()}
    assert [out[i].status for i in range(1, 9)] == ["valid", "repaired", "repaired", "repaired", "none", "valid", "none", "valid"]
    assert [i for i in range(1, 9) if not out[i].responded] == [5, 6, 7] and out[6].pred == 0  # a bare value is valid, but no answer
    assert out[1].pred == 1 and out[1].features == "a, b" and out[1].title == "t"
    assert out[2].pred == 0 and out[3].pred == 1 and out[4].pred == 1
    assert out[5].pred == 0 and out[8].pred == 0 and out[8].likelihood is None
    summ = RS.response_summary(RS.parse_response(RS.repair_json(df.withColumn("study_id", df.id % 3), "js"))).collect()[0]
    assert (summ.total, summ.valid, summ.repaired, summ.no_response, summ.patients) == (8, 3, 2, 3, 3)


def test_merge_with_human(spark):
    llm = spark.createDataFrame(
        [(1, "2024-01-01", "valid", 1, 10), (1, "2024-01-01", "none", 0, 11), (2, "2024-01-02", "none", 1, 12)],
        "study_id int, procedure_date string, status string, pred int, ord int",
    )
    hum = spark.createDataFrame([(1, "2024-01-01", 1, 5), (1, "2024-01-01", 0, 6), (2, "2024-01-02", 0, 7), (3, "2024-01-03", 1, 8)],
                                "study_id int, endoscopy_date string, gold int, ord int")
    m = {r.study_id: r for r in RS.merge_with_human(llm, hum, ["study_id", "procedure_date"], ["study_id", "endoscopy_date"]).collect()}
    assert sorted(m) == [1, 2]
    assert m[1].gold == 1 and m[1].pred == 1 and m[1].ord_human == 5 and m[1].ord_llm == 10
    assert m[2].pred is None  # failed answer -> null prediction
