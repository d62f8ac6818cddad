from cohortspark.schema import ReportSchema, wide_to_long
from cohortspark.sources import readers as RD
from cohortspark.sources import sinks as SK


def test_load_reports_csv(spark, tmp_path):
    p = tmp_path / "reports.csv"
    p.write_text(
        "study_id,histopathology_report_x,endoscopy_report,Histopath_IBD,Endoscopy_IBD,Preceding_Clinic_IBD,"
        "Following_Clinic_IBD,age,imd,ethnicity,IBD_Prediction\n"
        '12.0,"colitis seen",normal,1,NaN,0,,25,7,Pakistani,1\n'
        "13,,\"crohn's\",0,0,0,0,100,0,,0\n"
    )
    df = RD.load_reports(spark, str(p), ReportSchema())
    rows = {r.study_id: r for r in df.collect()}
    assert "IBD_Prediction" not in df.columns
    r = rows["12.0"]
    assert r.histopathology_report == "colitis seen"  # aliased from the column starting with the name
    assert r.age_group == "20-30" and r.imd_group == "7-8" and r.ethnicity == "Asian"
    assert r.Endoscopy_IBD is None and r.Patient_Has_IBD == 1.0
    assert r.combined_text == "colitis seen normal"  # only present text columns are joined
    s = rows["13"]
    assert s.age_group is None and s.imd_group == "1-2" and s.ethnicity == "Not Asked" and s.Patient_Has_IBD == 0.0
    assert s.combined_text == " crohn's"
    long = wide_to_long(df, ReportSchema())
    assert long.count() == 4  # two text columns present x two visits


def test_sinks_roundtrip(spark, tmp_path):
    ev = spark.createDataFrame([("validation", "final", "Regex", "patient", 0.1), ("train", "final", "Regex", "patient", 0.2)],
                               "dataset string, report_col string, pred_type string, level string, brier double")
    path = SK.write_eval(ev, str(tmp_path / "eval"))
    back = spark.read.parquet(path)
    assert back.count() == 2 and set(back.columns) >= {"pred_type", "level", "brier"}
    cs = SK.calibration_summary(ev).collect()
    assert len(cs) == 1 and cs[0].Brier_Score == 0.1
