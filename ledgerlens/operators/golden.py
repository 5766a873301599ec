"""Golden values: expected measure values with tolerances, two-person signoff, comparison.

Suites are tables (``golden_value``, ``golden_signoff``); actual values come
from the KPI jobs. Comparison is a left join on (client, period, measure) — a missing
actual is a failed row with an error, an unsigned suite produces
``GOLDEN_SUITE_UNSIGNED`` rows instead of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ratio_name
from .joins import broadcast_if_small

# Fixed values (parity with the reference).
TOLERANCE_PCT = 0.1
TOLERANCE_ABS_RATIO_PP = 0.05
VALUE_SCHEMA = ("measure_name STRING, period STRING, filter_context STRING, dax_filter STRING, expected_value DOUBLE, "
                "tolerance_pct DOUBLE, tolerance_abs DOUBLE, notes STRING, client STRING")
SIGNOFF_SCHEMA = ("seeded_by STRING, seeded_at STRING, verified_by STRING, verified_at STRING, client_signoff_email STRING, "
                  "client_signoff_at STRING, client STRING")
UNSIGNED_CODE = "GOLDEN_SUITE_UNSIGNED"
MISSING_ERROR = "Measure not found in actuals — not deployed or name mismatch"


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _period_of(*tables: DataFrame) -> list[str]:
    """The period column, if all tables have it: suites and actuals of one undated set of values go without."""
    return ["period"] if all("period" in t.columns for t in tables) else []


def signoff_status(signoff: DataFrame) -> DataFrame:
    """(client, is_complete, missing): both analysts set and different, client e-mail set."""
    missing = F.array_compact(F.array(
        F.when(_blank("seeded_by"), F.lit("seeded_by")),
        F.when(_blank("verified_by"), F.lit("verified_by")),
        F.when(~_blank("seeded_by") & ~_blank("verified_by") & (F.col("seeded_by") == F.col("verified_by")),
               F.lit("verified_by must differ from seeded_by")),
        F.when(_blank("client_signoff_email"), F.lit("client_signoff_email"))))
    complete = (~_blank("seeded_by") & ~_blank("verified_by") & (F.col("seeded_by") != F.col("verified_by"))
                & ~_blank("client_signoff_email"))
    return signoff.select("client", complete.alias("is_complete"), F.array_join(missing, ",").alias("missing"))


def compare(values: DataFrame, actuals: DataFrame, signoff: DataFrame, allow_unsigned: bool = False) -> DataFrame:
    """golden_result(client, period, measure_name, expected, actual, passed, deviation_pct, error).

    A suite is seeded for a period; its values are held against that period's actuals only.
    """
    st = signoff_status(signoff)
    v = values.join(broadcast_if_small(st), "client", "left") \
        .withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))
    period = _period_of(values, actuals)
    a = actuals.select("client", *period, "measure_name", F.col("value").alias("actual"))
    j = v.join(a, ["client", *period, "measure_name"], "left")
    exp, act = F.col("expected_value"), F.col("actual")
    diff = F.abs(act - exp)
    has_abs = F.col("tolerance_abs").isNotNull()
    dev = F.when(exp == 0, diff * 100).otherwise(diff / F.abs(exp) * 100)
    dev_rel = F.when(exp == 0, F.abs(act) * 100).otherwise(diff / F.abs(exp) * 100)
    passed = (F.when(act.isNull(), F.lit(False))
              .when(has_abs, diff <= F.col("tolerance_abs"))
              .when(exp == 0, F.abs(act) <= F.col("tolerance_pct"))
              .otherwise(diff / F.abs(exp) * 100 <= F.col("tolerance_pct")))
    deviation = F.when(act.isNull(), F.lit(None).cast("double")).when(has_abs, dev).otherwise(dev_rel)
    error = F.when(act.isNull(), F.lit(MISSING_ERROR)).otherwise(F.lit(""))
    gate = F.col("is_complete") | F.lit(allow_unsigned)
    return j.select(
        "client", *period, "measure_name", F.col("expected_value").alias("expected"),
        F.when(gate, act).alias("actual"),
        F.when(gate, passed).otherwise(F.lit(False)).alias("passed"),
        F.when(gate, deviation).alias("deviation_pct"),
        F.when(gate, error).otherwise(F.lit(UNSIGNED_CODE)).alias("error"))


def report(results: DataFrame) -> DataFrame:
    """Pass count per client."""
    return results.groupBy("client").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def bootstrap(actuals: DataFrame, tolerance_pct: float = TOLERANCE_PCT) -> DataFrame:
    """Seed a suite from trusted actuals: ratio-like names get an absolute 0.05 pp band, others 0.1 %."""
    ratio = is_ratio_name(F.col("measure_name"))
    return actuals.select(
        "client", *_period_of(actuals), "measure_name", F.lit("All data, no filter").alias("filter_context"), F.lit("").alias("dax_filter"),
        F.col("value").alias("expected_value"),
        F.when(ratio, F.lit(None).cast("double")).otherwise(F.lit(tolerance_pct)).alias("tolerance_pct"),
        F.when(ratio, F.lit(TOLERANCE_ABS_RATIO_PP)).otherwise(F.lit(None).cast("double")).alias("tolerance_abs"),
        F.when(ratio, "ratio").otherwise("relative").alias("band"))


def analyst_suites(signoff: DataFrame, analyst: str, left_on: str | None = None) -> DataFrame:
    """Suites verified by ``analyst``; when the analyst leaves they count as unsigned until re-verified (60 days)."""
    s = signoff.where(F.col("verified_by") == analyst).select("client", "verified_by", "verified_at")
    if left_on is not None:
        s = s.withColumn("reverify_by", F.date_add(F.lit(left_on).cast("date"), 60))
    return s


def save_suite(values: DataFrame, signoff: DataFrame, path: str) -> None:
    """A suite is two tables (values, signoff) with the columns of VALUE_SCHEMA and SIGNOFF_SCHEMA, written as JSON per client."""
    values.write.mode("overwrite").partitionBy("client").json(f"{path}/values")
    signoff.write.mode("overwrite").partitionBy("client").json(f"{path}/signoff")


def load_suite(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables as they were saved; columns that a suite does not have are NULL."""
    return spark.read.schema(VALUE_SCHEMA).json(f"{path}/values"), spark.read.schema(SIGNOFF_SCHEMA).json(f"{path}/signoff")
