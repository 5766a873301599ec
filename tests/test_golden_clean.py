from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import clean_month as CM
from ledgerlens.operators import golden as GD
from tests.conftest import rows

SIGNED = ("c", "a1", "a2", "cfo@x")


def _suite(spark, tests, signoff=SIGNED):
    v = spark.createDataFrame([("c",) + t for t in tests],
                              "client string, measure_name string, expected_value double, tolerance_pct double, "
                              "tolerance_abs double")
    s = spark.createDataFrame([signoff], "client string, seeded_by string, verified_by string, client_signoff_email string")
    return v, s


def _actuals(spark, d):
    return spark.createDataFrame([("c", k, v) for k, v in d.items()], "client string, measure_name string, value double")


def test_tolerance_bands(spark):
    v, s = _suite(spark, [("rev", 100000.0, 0.1, None), ("rev2", 100000.0, 0.1, None), ("margin", 12.4, 0.1, None),
                          ("margin_abs", 12.4, 0.1, 0.05), ("missing", 1.0, 0.1, None), ("zero", 0.0, 0.1, None)])
    a = _actuals(spark, {"rev": 100050.0, "rev2": 101000.0, "margin": 12.42, "margin_abs": 12.42, "zero": 0.05})
    r = {x["measure_name"]: x for x in rows(GD.compare(v, a, s))}
    assert r["rev"]["passed"] and not r["rev2"]["passed"]
    assert not r["margin"]["passed"] and r["margin_abs"]["passed"]   # absolute band wins
    assert not r["missing"]["passed"] and r["missing"]["error"].startswith("Measure not found")
    assert r["zero"]["passed"]


def test_unsigned_suite_refused(spark):
    for so in [("c", "a1", "", "cfo@x"), ("c", "a1", "a1", "cfo@x"), ("c", "a1", "a2", "")]:
        v, s = _suite(spark, [("rev", 1.0, 0.1, None)], so)
        r = rows(GD.compare(v, _actuals(spark, {"rev": 1.0}), s))[0]
        assert r["error"] == GD.UNSIGNED_CODE and not r["passed"]
    st = rows(GD.signoff_status(_suite(spark, [], ("c", "a1", "a1", ""))[1]))[0]
    assert not st["is_complete"]
    assert st["missing"] == "verified_by must differ from seeded_by,client_signoff_email"


def test_bootstrap_bands(spark):
    b = {r["measure_name"]: r for r in GD.bootstrap(_actuals(spark, {"gross_margin_pct": 12.0, "revenue": 5.0})).collect()}
    assert b["gross_margin_pct"]["tolerance_abs"] == 0.05 and b["gross_margin_pct"]["tolerance_pct"] is None
    assert b["revenue"]["tolerance_pct"] == 0.1


def _entry(rid, period, delivery="email:ceo@x", passed=True, drift=True, late=False, src="h1", resp="r1", codes=(),
           gen=None, seq=0):
    flags = [("block" if c == "FALLBACK_COMMENTARY" else "warn", c, "") for c in codes]
    return (rid, "Acme", period, gen or f"{period}-28T10:00:00", src, "p", resp, passed, flags, delivery, drift, late,
            None, seq)


AUDIT_T = ("report_id string, client_name string, period string, generated_at string, source_data_hash string, "
           "prompt_hash string, response_hash string, gate_passed boolean, "
           "gate_flags array<struct<severity:string,code:string,message:string>>, delivery string, "
           "schema_drift_clean boolean, late_correction boolean, supersedes string, seq int")


def _clean(spark, entries, corrections=()):
    a = spark.createDataFrame(entries, AUDIT_T)
    c = spark.createDataFrame(list(corrections), "report_id string")
    return {r["period"]: r for r in rows(CM.clean_months(a, c))}


def test_clean_month_criteria(spark):
    assert _clean(spark, [_entry("r1", "2024-07")])["2024-07"]["is_clean"]
    assert _clean(spark, [_entry("r1", "2024-07", passed=False)])["2024-07"]["failed"] == "C1"
    assert _clean(spark, [_entry("r1", "2024-07")], [("r1",)])["2024-07"]["failed"] == "C2"
    assert _clean(spark, [_entry("r1", "2024-07", drift=False)])["2024-07"]["failed"] == "C3"
    nd = _clean(spark, [_entry("r1", "2024-07"), _entry("r1", "2024-07", resp="r2", seq=1)])
    assert nd["2024-07"]["failed"] == "C4_nondeterministic"
    late = _clean(spark, [_entry("r1", "2024-07"), _entry("r2", "2024-07", late=True, src="h2", resp="r9", seq=1)])
    assert late["2024-07"]["failed"] == "C4_late"
    assert _clean(spark, [_entry("r1", "2024-07", delivery="dry_run")])["2024-07"]["failed"] == "C5"
    assert _clean(spark, [_entry("r1", "2024-07", codes=("GOLDEN_SUITE_UNSIGNED",))])["2024-07"]["failed"] == "C6"
    assert _clean(spark, [_entry("r1", "2024-07", codes=("FALLBACK_COMMENTARY",))])["2024-07"]["failed"] == "C7"
    # a July report generated in August counts for July
    assert _clean(spark, [_entry("r1", "2024-07", gen="2024-08-01T09:00:00")])["2024-07"]["is_clean"]


def test_rolling_window(spark):
    months = ["2024-05", "2024-06", "2024-07", "2024-08", "2024-09", "2024-10"]
    a = spark.createDataFrame([_entry(f"r{i}", m) for i, m in enumerate(months)], AUDIT_T)
    c0 = spark.createDataFrame([], "report_id string")
    el = {r["anchor_month"]: r["eligible"] for r in CM.rolling_eligibility(CM.clean_months(a, c0)).collect()}
    assert el["2024-11"] is True
    c1 = spark.createDataFrame([("r2",)], "report_id string")
    cm = CM.clean_months(a, c1)
    assert {r["anchor_month"]: r["eligible"] for r in CM.rolling_eligibility(cm).collect()}["2024-11"] is False
    e = rows(CM.earliest_eligibility(cm))[0]
    assert e["last_dirty_month"] == "2024-07" and e["window_end_month"] == "2025-01"


def test_audit_lookups_and_chain(spark):
    a = spark.createDataFrame([_entry("r1", "2024-07"), _entry("r2", "2024-07", late=True, gen="2024-09-01T00:00:00", seq=1)],
                              AUDIT_T).withColumn("supersedes", F.when(F.col("report_id") == "r2", "r1"))
    assert rows(AU.latest(a))[0]["report_id"] == "r2"
    assert rows(AU.original(a))[0]["report_id"] == "r1"
    ch = {r["report_id"]: (r["root_id"], r["depth"]) for r in AU.supersedes_chain(spark, a).collect()}
    assert ch == {"r1": ("r1", 0), "r2": ("r1", 1)}


def test_log_roundtrip(spark, tmp_path):
    a = spark.createDataFrame([_entry("r1", "2024-07")], AUDIT_T).drop("seq")
    AU.write_log(a, str(tmp_path / "audit"))
    (tmp_path / "audit" / "client_slug=acme" / "year=2024" / "bad.json").write_text("{not json\n")
    back = AU.read_log(spark, str(tmp_path / "audit"))
    assert [r["report_id"] for r in back.collect()] == ["r1"]
    assert rows(back)[0]["late_correction"] is False


def test_criterion_details_name_first_three_in_log_order(spark):
    entries = [_entry(f"r{i}", "2024-07", passed=False, gen=f"2024-08-0{9 - i}T10:00:00", src=f"h{i}") for i in range(5)]
    entries += [_entry("x1", "2024-07", src="hx"), _entry("x2", "2024-07", src="hx", resp="other", seq=1),
                _entry("d1", "2024-07", drift=False, src="hd")]
    a = spark.createDataFrame(entries, AUDIT_T)
    c = spark.createDataFrame([("x1", "2024-08-02"), ("r4", "2024-08-01"), ("nope", "2024-08-01")],
                              "report_id string, logged_at string")
    got = {r["criterion"]: (r["n"], r["report_ids"]) for r in rows(CM.criterion_details(a, c))}
    assert got["C1"] == (5, "r4, r3, r2")           # earliest generated first
    assert got["C2"] == (2, "r4, x1")               # only corrections of delivered reports, by logged_at
    assert got["C3"] == (1, "")
    assert got["C4_nondeterministic"] == (1, "")    # one source hash with two responses
    assert set(got) == {"C1", "C2", "C3", "C4_nondeterministic"}
