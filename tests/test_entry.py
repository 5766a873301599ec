import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["client", "period", "rank", "kpi", "pct"]
    assert df.count() > 0


def test_registry_contract():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60
    for name in ("kpi_snapshot", "gate_result", "clean_month", "sanitize_text", "scan_delimited", "golden_compare"):
        assert name in qs and name in sql


def test_gate_coverage_has_no_holes(spark):
    cov = E.queries()["gate_coverage"](spark, "/root/testdata/sf0.001").collect()
    assert len(cov) == 12
    assert all(r["holes"] == 0 for r in cov), [r for r in cov if r["holes"]]
    assert all(r["applicable"] > 0 for r in cov)
