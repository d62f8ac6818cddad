import re

from conftest import SF_SMALL

from cohortspark.operators import study as ST
from cohortspark.plans import registry


def test_sample_size_constant():
    assert round(ST.required_sample_size(0.05, 4, 0.9, 0.8), 1) == 541.5


def test_vif_and_correlation(spark):
    rows = [(float(i % 2), float((i // 2) % 2), float((i % 2) ^ ((i // 3) % 2))) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    v = {r.feature: r.vif for r in ST.vif(df, ["a", "b", "c"]).collect()}
    assert all(x >= 1.0 for x in v.values())
    corr = {(r.a, r.b): r.corr for r in ST.label_correlation(df, ["a", "b"]).collect()}
    assert abs(corr[("a", "a")] - 1.0) < 1e-12


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    # The corpus operators have names of their own; they are added where their package is there.
    own = registry.queries()
    assert set(own) <= set(qs)
    for name in own:
        assert "pipeline" not in name and not re.match(r"op\d+_", name)


def test_every_query_small_scale(spark):
    """Every registered query of the library runs over the sf0.001 tables and returns a stable schema."""
    for name, fn in registry.queries().items():
        df = fn(spark, SF_SMALL)
        assert df.columns, name
        df.limit(1).collect()
