"""Run records derived from the gate results: audit log, corrections, golden suites, call costs.

The test data has no logs, so each report (client, period) gets the record
the pipeline would have written, with re-runs, late corrections, overridden
deliveries, drift and unsigned suites planted on fixed residues of the same
seed as the commentary. ``LEDGER_SQL`` repeats the arithmetic for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha16
from ..operators.audit import correction_severity, report_id
from ..operators.cost import priced
from ..operators.snapshot import period_start
from .commentary import seed_col

_FLAG_T = "array<struct<severity:string,code:string,message:string>>"


def _gen_at(months: int, day: str = "01") -> F.Column:
    return F.concat(F.date_format(F.add_months(period_start(), months), "yyyy-MM"), F.lit(f"-{day}T08:00:00"))


def derive_audit(gres: DataFrame, flags: DataFrame, snap: DataFrame) -> DataFrame:
    """audit(report_id, client_name, period, seq, generated_at, hashes, gate_passed, gate_flags, delivery, ...)."""
    codes = flags.groupBy("client", "period").agg(
        F.array_sort(F.collect_list(F.struct("severity", "code", "message"))).alias("_flags"))
    b = (gres.join(snap.select("client", "period", "row_count"), ["client", "period"])
         .join(codes, ["client", "period"], "left").withColumn("_s", seed_col()))
    s = F.col("_s")
    flags_arr = F.coalesce(F.col("_flags"), F.array().cast(_FLAG_T))
    unsigned = F.array(F.struct(F.lit("warn").alias("severity"), F.lit("GOLDEN_SUITE_UNSIGNED").alias("code"),
                                F.lit("").alias("message")))
    gate_flags = F.when(s % 19 == 0, F.concat(flags_arr, unsigned)).otherwise(flags_arr)
    src = sha16(F.concat_ws("|", "client", "period", F.col("row_count").cast("string")))
    rid = report_id(F.col("client"), F.col("period"), src, F.lit(False))
    email = F.concat(F.lit("email:cfo@"), F.lower("client"), F.lit(".example"))
    held = F.concat(F.lit("held:pending/"), F.lower("client"), F.lit("_"), F.col("period"), F.lit(".json"))
    common = [F.col("client").alias("client_name"), "period"]
    base = b.select(
        rid.alias("report_id"), *common, F.lit(0).alias("seq"), _gen_at(1).alias("generated_at"),
        src.alias("source_data_hash"), sha16(F.concat_ws("|", F.lit("prompt"), "client", "period")).alias("prompt_hash"),
        sha16(F.concat_ws("|", F.lit("resp"), "client", "period")).alias("response_hash"),
        F.col("passed").alias("gate_passed"), gate_flags.alias("gate_flags"),
        F.when(F.col("passed") | (s % 7 == 0), email).otherwise(held).alias("delivery"),
        (s % 17 != 0).alias("schema_drift_clean"), F.lit(False).alias("late_correction"),
        F.lit(None).cast("string").alias("supersedes"), s.alias("_s"))
    rerun = base.where(F.col("_s") % 13 == 0).withColumn("seq", F.lit(1)) \
        .withColumn("generated_at", _gen_at(1, "02")) \
        .withColumn("response_hash", sha16(F.concat_ws("|", F.lit("resp2"), "client_name", "period")))

    def late(k: int, months: int, mod: int, prev: F.Column) -> DataFrame:
        src2 = sha16(F.concat_ws("|", "client_name", "period", F.lit(f"fixed{k}")))
        return base.where(F.col("_s") % mod == 0).select(
            report_id(F.col("client_name"), F.col("period"), src2, F.lit(True)).alias("report_id"),
            "client_name", "period", F.lit(1 + k).alias("seq"), _gen_at(months).alias("generated_at"),
            src2.alias("source_data_hash"), "prompt_hash",
            sha16(F.concat_ws("|", F.lit(f"resp-fixed{k}"), "client_name", "period")).alias("response_hash"),
            F.lit(True).alias("gate_passed"), F.array().cast(_FLAG_T).alias("gate_flags"),
            F.concat(F.lit("email:cfo@"), F.lower("client_name"), F.lit(".example")).alias("delivery"),
            F.lit(True).alias("schema_drift_clean"), F.lit(True).alias("late_correction"), prev.alias("supersedes"),
            F.col("_s"))

    late1 = late(1, 2, 11, F.col("report_id"))
    prev1 = report_id(F.col("client_name"), F.col("period"),
                      sha16(F.concat_ws("|", "client_name", "period", F.lit("fixed1"))), F.lit(True))
    late2 = late(2, 3, 22, prev1)
    return base.unionByName(rerun).unionByName(late1).unionByName(late2).drop("_s")


def derive_corrections(audit: DataFrame, snap: DataFrame) -> DataFrame:
    """A disputed total for delivered original reports on residue 5 (3 % off on residue 10, else 1 %)."""
    a = (audit.where((F.col("seq") == 0) & F.col("delivery").startswith("email:"))
         .join(snap.select(F.col("client").alias("client_name"), "period", "row_count"), ["client_name", "period"])
         .withColumn("_s", F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")
                     + F.length("client_name")))
    claimed = F.col("row_count") * F.lit(100.0)
    actual = claimed * F.when(F.col("_s") % 10 == 0, F.lit(1.03)).otherwise(F.lit(1.01))
    c = a.where(F.col("_s") % 5 == 0)
    return c.select("report_id", _gen_at(2, "15").alias("logged_at"), F.lit("analyst_b").alias("logged_by"),
                    F.lit("kpi_deltas.total_revenue.current").alias("field"), claimed.alias("claimed_value"),
                    actual.alias("actual_value"), F.lit("client ledger").alias("source_of_truth"),
                    correction_severity(claimed, actual).alias("severity"), "client_name")


def derive_actuals(kpi: DataFrame) -> DataFrame:
    """Measure values of every report: the KPIs plus discount_rate (percent)."""
    k = kpi
    rate = (k.groupBy("client", "period").agg(
        F.max(F.when(F.col("kpi") == "total_discount", F.col("value"))).alias("_d"),
        F.max(F.when(F.col("kpi") == "total_revenue", F.col("value"))).alias("_r"))
        .select("client", "period", F.lit("discount_rate").alias("measure_name"),
                (F.col("_d") / (F.col("_r") + F.col("_d")) * 100).alias("value")))
    return k.select("client", "period", F.col("kpi").alias("measure_name"), "value").unionByName(rate)


def derive_golden(actuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(golden_value, golden_signoff) seeded from the actuals with known deviations planted."""
    v, m = F.col("value"), F.col("measure_name")
    even = F.length("client") % 2 == 0
    expected = (F.when(m == "total_revenue", v * 1.0005).when(m == "avg_revenue", v * 1.01)
                .when(m == "total_discount", v + 0.5)
                .when(m == "discount_rate", v + F.when(even, F.lit(0.04)).otherwise(F.lit(0.06))).otherwise(v))
    tol_abs = F.when(m == "total_discount", F.lit(1.0)).when(m == "discount_rate", F.lit(0.05)) \
        .otherwise(F.lit(None).cast("double"))
    keep = m.isin("total_revenue", "avg_revenue", "total_quantity", "total_discount", "discount_rate")
    vals = actuals.where(keep).select("client", "period", "measure_name", expected.alias("expected_value"),
                                      F.lit(0.1).alias("tolerance_pct"), tol_abs.alias("tolerance_abs"))
    missing = actuals.select("client", "period").distinct().select(
        "client", "period", F.lit("total_profit").alias("measure_name"), F.lit(1000.0).alias("expected_value"),
        F.lit(0.1).alias("tolerance_pct"), F.lit(None).cast("double").alias("tolerance_abs"))
    signoff = actuals.select("client").distinct().select(
        "client", F.lit("analyst_a").alias("seeded_by"),
        F.when(F.col("client").startswith("A"), "analyst_a").when(F.col("client").startswith("F"), "")
         .otherwise("analyst_b").alias("verified_by"),
        F.when(F.col("client").startswith("H"), "").otherwise(
            F.concat(F.lit("finance@"), F.lower("client"), F.lit(".example"))).alias("client_signoff_email"))
    return vals.unionByName(missing), signoff


def derive_costs(delta: DataFrame, snap: DataFrame) -> DataFrame:
    """One commentary call per report, one measure-generation call in each January."""
    n = delta.groupBy("client", "period").agg(F.count(F.lit(1)).alias("_k"))
    b = n.join(snap.select("client", "period", "row_count"), ["client", "period"]).withColumn("_s", seed_col())
    s = F.col("_s")
    comm = b.select(F.col("client").alias("client_name"), "period", F.lit("ai_commentary").alias("step"),
                    F.lit("text-model-1").alias("model"), (F.col("row_count") + 800).alias("input_tokens"),
                    (F.col("_k") * 40 + 200).alias("output_tokens"),
                    F.when(s % 2 == 1, F.lit(600)).otherwise(F.lit(0)).cast("long").alias("cache_write_tokens"),
                    F.when(s % 2 == 0, F.lit(600)).otherwise(F.lit(0)).cast("long").alias("cache_read_tokens"))
    dax = b.where(F.substring("period", 6, 2) == "01").select(
        F.col("client").alias("client_name"), "period", F.lit("dax_generation").alias("step"),
        F.lit("text-model-1").alias("model"), F.lit(1500).cast("long").alias("input_tokens"),
        F.lit(900).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"),
        F.lit(0).cast("long").alias("cache_read_tokens"))
    return priced(comm.unionByName(dax))
