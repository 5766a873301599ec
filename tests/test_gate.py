from pyspark.sql import functions as F

from ledgerlens.operators import gate as G
from ledgerlens.operators import reconcile as R
from ledgerlens.operators import synonyms as S
from ledgerlens.functions.numbers import number_tokens
from tests.conftest import rows

FINDING_T = "array<struct<kpi_id:string,direction:string,magnitude_pct:double,context:string>>"
RCA_T = "struct<claims:array<struct<claim:string,evidence_kpi:string,evidence_value:string>>,unsupported_factors:array<string>>"


def _delta(spark, kpis):
    data = [("c", "2024-03", "2024-02", k, i, cur, prev, cur - prev, 0.0 if prev == 0 else (cur - prev) / prev * 100)
            for i, (k, cur, prev) in enumerate(kpis, start=1)]
    return spark.createDataFrame(data, "client string, period string, prev_period string, kpi string, kpi_ord int, "
                                       "current double, previous double, abs double, pct double")


BASE = [("total_revenue", 95600.0, 90531.0), ("total_cost", 46000.0, 50000.0), ("total_qty", 1050.0, 1000.0)]


def _comm(spark, findings, headline="Revenue rose 5.6%", summary="Costs were managed.", claims=2):
    claim = ("price", "total_revenue", "5.6")
    data = [("c", "2024-03", headline, summary, findings, ([claim] * claims, []))]
    return spark.createDataFrame(data, f"client string, period string, headline string, executive_summary string, "
                                       f"key_findings {FINDING_T}, rca {RCA_T}")


def _pair(spark, cur_rows, prev_rows, cur_days=30, prev_days=29):
    return spark.createDataFrame([("c", "2024-03", "2024-02", cur_rows, cur_days, prev_rows, prev_days)],
                                 "client string, period string, prev_period string, row_count bigint, "
                                 "period_days bigint, prev_row_count bigint, prev_period_days bigint")


def _codes(df):
    return sorted(r["code"] for r in df.collect())


def test_row_count(spark):
    assert _codes(G.row_count_flags(_pair(spark, 60, 100))) == ["ROW_COUNT_DROP"]
    assert _codes(G.row_count_flags(_pair(spark, 80, 100))) == ["ROW_COUNT_LOW"]
    assert _codes(G.row_count_flags(_pair(spark, 160, 100))) == ["ROW_COUNT_SPIKE"]
    assert _codes(G.row_count_flags(_pair(spark, 100, 100))) == []
    assert _codes(G.row_count_flags(_pair(spark, 0, 100))) == []


def test_period_length(spark):
    r = rows(G.period_length_flags(_pair(spark, 1, 1, 31, 28)))
    assert [(x["severity"], x["metric"]) for x in r] == [("warn", 3.0)]
    assert rows(G.period_length_flags(_pair(spark, 1, 1, 30, 20)))[0]["severity"] == "block"
    assert rows(G.period_length_flags(_pair(spark, 1, 1, 30, 29))) == []


def test_delta_static_threshold(spark):
    d = _delta(spark, [("a", 120.0, 100.0), ("b", 110.0, 100.0), ("c", 105.0, 100.0)])
    assert {(r["subject"], r["code"]) for r in G.delta_flags(d).collect()} == {("a", "ANOMALOUS_DELTA"),
                                                                               ("b", "NOTABLE_DELTA")}


def test_delta_profile_threshold(spark):
    d = _delta(spark, [("a", 120.0, 100.0)])
    thr = spark.createDataFrame([("c", "a", 40.0)], "client string, kpi string, threshold_pct double")
    assert _codes(G.delta_flags(d, thr)) == []


def test_findings_good_and_bad(spark):
    d = _delta(spark, BASE)
    good = [("total_revenue", "up", 5.6, "sales picked up"), ("total_cost", "down", 8.0, ""),
            ("total_qty", "up", 5.0, "")]
    assert _codes(G.findings_flags(_comm(spark, good), d)) == []
    bad = [("total_revenue", "down", 5.6, ""), ("total_cost", "down", 30.0, ""), ("total_profit", "up", 1.0, ""),
           ("", "up", 1.0, "legacy prose")]
    assert _codes(G.findings_flags(_comm(spark, bad), d)) == sorted(
        ["FINDING_DIRECTION_MISMATCH", "FINDING_MAGNITUDE_MISMATCH", "UNKNOWN_KPI", "MALFORMED_FINDING"])
    assert _codes(G.findings_flags(_comm(spark, []), d)) == ["NO_FINDINGS"]


def test_context_leaks(spark):
    d = _delta(spark, BASE)
    defaults = S.default_synonyms(spark)

    def leak(ctx):
        c = _comm(spark, [("total_revenue", "up", 5.6, ctx)])
        return [r["leaked"] for r in G.leak_rows(c, d, defaults).collect()]

    assert leak("sales picked up") == []
    assert leak("cogs compression") == ["cogs"]
    assert leak("cost compression") == ["cost"]
    assert leak("costume sales") == []


def test_client_synonym_override(spark):
    d = _delta(spark, BASE)
    ov = spark.createDataFrame([("c", "revenue", "cogs")], "client string, token string, alt string")
    c = _comm(spark, [("total_revenue", "up", 5.6, "cogs compression")])
    assert [r["leaked"] for r in G.leak_rows(c, d, S.default_synonyms(spark), ov).collect()] == []


def _recon(spark, text):
    cur_q, cur_r = 1120.0, 97650.0
    d = _delta(spark, [("total_qty", cur_q, cur_q / 1.12), ("total_revenue", cur_r, cur_r / 1.085)])
    c = _comm(spark, [], headline=text, summary="")
    nums = R.extract_numbers(c.select("client", "period", G.prose(c).alias("t")), "t")
    return R.reconciliation_flags(nums, d), R.reconciliation_summary(nums, d)


def test_reconciliation(spark):
    flags, summ = _recon(spark, "Volume grew 12% this month.")
    assert _codes(flags) == [] and rows(summ)[0]["numbers_matched"] == 1
    assert _codes(_recon(spark, "Volume grew 50% this month.")[0]) == ["NUMERIC_MISMATCH"]
    assert _codes(_recon(spark, "Volume grew 14.5%.")[0]) == ["NUMERIC_APPROXIMATION"]
    assert _codes(_recon(spark, "Revenue reached €97,650 this month.")[0]) == []
    assert rows(_recon(spark, "Results were stable overall.")[1]) == []
    assert _codes(_recon(spark, "Revenue reached €250,000.")[0]) == ["UNVERIFIABLE_ABSOLUTE"]


def test_number_tokens(spark):
    df = spark.createDataFrame([("Revenue is €1.2M and volume is 1.5k units. Grew 12.4% this quarter.",)], "t string")
    toks = df.select(F.inline(number_tokens(F.col("t")))).collect()
    vals = {r["value"] for r in toks}
    assert 1_200_000 in vals and 1_500 in vals
    pcts = [r for r in toks if r["is_pct"]]
    assert len(pcts) == 1 and abs(pcts[0]["value"] - 12.4) < 1e-9


def test_citations_direction_fallback_round(spark):
    d = _delta(spark, BASE + [("total_amount", 100.0, 90.0)])
    assert _codes(G.citation_flags(_comm(spark, [], claims=0))) == ["NO_CITATIONS"]
    assert _codes(G.citation_flags(_comm(spark, [], claims=1))) == ["WEAK_CITATION"]
    assert _codes(G.citation_flags(_comm(spark, [], claims=2))) == []
    c = _comm(spark, [], headline="Revenue fell sharply", summary="")
    assert _codes(G.direction_conflict_flags(c, d)) == ["DIRECTION_CONFLICT", "DIRECTION_CONFLICT"]
    mixed = _comm(spark, [], headline="Revenue rose; costs fell", summary="")
    assert _codes(G.direction_conflict_flags(mixed, d)) == []
    assert _codes(G.fallback_flags(_comm(spark, [], headline="[AI UNAVAILABLE] draft"))) == ["FALLBACK_COMMENTARY"]
    assert sorted(r["subject"] for r in G.round_number_flags(d).collect()) == ["total_amount:current",
                                                                               "total_qty:previous"]


def test_gate_result_passes_clean_report(spark):
    d = _delta(spark, BASE)
    good = [("total_revenue", "up", 5.6, "sales picked up"), ("total_cost", "down", 8.0, ""),
            ("total_qty", "up", 5.0, "")]
    c = _comm(spark, good, headline="Revenue rose 5.6%", summary="Revenue reached €95,600.")
    flags = G.run_gate(_pair(spark, 1000, 1000), d, c, S.default_synonyms(spark))
    res = rows(G.gate_result(flags, d))[0]
    assert res["passed"], res
