"""Gate coverage: known-bad mutations of every report, run through the whole gate once.

For each report a clean baseline commentary is derived (correct findings,
own-vocabulary contexts, matching numbers, two citations). Each of the twelve
mutation cases below corrupts it in one way and names the code the gate must
raise. Cases are generated with ``explode`` (no join), keyed as
``client#case``; the gate runs once over all of them; a hole is an applicable
case whose expected code is absent (``left_anti``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import direction_from_pct
from ..operators import gate as G
from .commentary import CONTEXT_OWN, _measure_case

# Mutation cases and the code each must raise (parity with the reference's list).
CASES = [
    ("row_count_drop", "ROW_COUNT_DROP"),
    ("period_length_mismatch", "PERIOD_LENGTH_MISMATCH"),
    ("flip_direction", "FINDING_DIRECTION_MISMATCH"),
    ("inflate_magnitude", "FINDING_MAGNITUDE_MISMATCH"),
    ("unknown_kpi_id", "UNKNOWN_KPI"),
    ("empty_kpi_id", "MALFORMED_FINDING"),
    ("context_leak_simple", "CONTEXT_KPI_LEAK"),
    ("context_leak_synonym", "CONTEXT_KPI_LEAK"),
    ("remove_citations", "NO_CITATIONS"),
    ("direction_conflict_summary", "DIRECTION_CONFLICT"),
    ("inflated_number_in_summary", "NUMERIC_MISMATCH"),
    ("fallback_commentary", "FALLBACK_COMMENTARY"),
]
STATIC_THRESHOLD_PCT = 200.0


def _explode_cases(df: DataFrame) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("case_id"), F.lit(code).alias("expected_code")) for c, code in CASES])
    return df.select("*", F.inline(arr)).withColumn("client", F.concat("client", F.lit("#"), "case_id"))


def mutated_inputs(pair: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pair, delta, commentary, applicable) for every report x case."""
    cid = F.col("case_id")
    p = _explode_cases(pair)
    p = p.withColumn("prev_row_count", F.when(cid == "row_count_drop", F.col("row_count") * 2)
                     .otherwise(F.col("prev_row_count"))) \
        .withColumn("prev_period_days", F.when(cid == "period_length_mismatch", F.col("period_days") + 10)
                    .otherwise(F.col("prev_period_days")))
    d = _explode_cases(delta)
    dirn = direction_from_pct(F.col("pct"))
    first = F.col("kpi_ord") == 1
    flipped = F.when(dirn == "up", "down").when(dirn == "down", "up").otherwise("up")
    finding = F.struct(
        F.col("kpi_ord").alias("ord"),
        F.when(first & (cid == "unknown_kpi_id"), F.lit("total_profit_margin"))
         .when(first & (cid == "empty_kpi_id"), F.lit("")).otherwise(F.col("kpi")).alias("kpi_id"),
        F.when(first & (cid == "flip_direction"), flipped).otherwise(dirn).alias("direction"),
        (F.abs("pct") + F.when((cid == "inflate_magnitude") & (dirn != "flat") & (F.col("_top") == 1), F.lit(25.0))
         .otherwise(F.lit(0.0))).alias("magnitude_pct"),
        F.when(first & (cid == "context_leak_simple"), F.lit("quantity slipped"))
         .when(first & (cid == "context_leak_synonym"), F.lit("units shipped"))
         .otherwise(_measure_case(CONTEXT_OWN)).alias("context"))
    top = Window.partitionBy("client", "period").orderBy((F.col("kpi_ord") <= 5).desc(), F.abs("pct").desc(), "kpi_ord")
    d5 = d.withColumn("_top", F.row_number().over(top))
    rev = F.col("kpi") == "total_revenue"
    per = d5.groupBy("client", "period", "case_id").agg(
        F.collect_list(F.when(F.col("kpi_ord") <= 5, finding)).alias("_f"),
        F.max(F.when(rev, F.col("pct"))).alias("_pct"), F.max(F.when(rev, F.col("current"))).alias("_cur"),
        F.max(F.when(rev, F.col("previous"))).alias("_prev"), F.max(F.abs("pct")).alias("_maxpct"),
        F.max(F.when((F.col("kpi_ord") <= 5) & (F.abs("pct") >= 3), F.lit(True))).alias("_has_move"))
    up = F.col("_pct") > 0
    headline = F.concat(F.lit("Revenue "), F.when(up, "rose").otherwise("fell"), F.lit(" "),
                        F.floor(F.abs("_pct")).cast("string"), F.lit("%"))
    summary = F.concat(F.lit("Total revenue reached €"), F.format_number(F.floor("_cur"), 0), F.lit(" against €"),
                       F.format_number(F.floor("_prev"), 0), F.lit(" in the prior month."))
    headline = (F.when(cid == "fallback_commentary", F.concat(F.lit("[AI UNAVAILABLE] "), headline))
                .when(cid == "direction_conflict_summary", F.lit("Revenue update")).otherwise(headline))
    summary = (F.when(cid == "direction_conflict_summary",
                      F.when(up, F.lit("Revenue fell sharply.")).otherwise(F.lit("Revenue grew strongly.")))
               .when(cid == "inflated_number_in_summary",
                     # thousands separator: a bare 4-digit number would split into two tokens
                     F.concat(summary, F.lit(" Margin improved by "), F.format_number(F.floor("_maxpct") + 100, 0),
                              F.lit("%.")))
               .otherwise(summary))
    claim = F.struct(F.lit("price mix").alias("claim"), F.lit("total_revenue").alias("evidence_kpi"),
                     F.lit("").alias("evidence_value"))
    claims = F.when(cid == "remove_citations", F.array().cast(
        "array<struct<claim:string,evidence_kpi:string,evidence_value:string>>")).otherwise(F.array(claim, claim))
    findings = F.transform(F.array_sort("_f"), lambda x: F.struct(
        x["kpi_id"].alias("kpi_id"), x["direction"].alias("direction"),
        x["magnitude_pct"].alias("magnitude_pct"), x["context"].alias("context")))
    comm = per.select("client", "period", headline.alias("headline"), summary.alias("executive_summary"),
                      findings.alias("key_findings"),
                      F.struct(claims.alias("claims"), F.array().cast("array<string>").alias("unsupported_factors"))
                      .alias("rca"))
    # A magnitude can only be wrong for a non-flat KPI; a revenue direction conflict needs a revenue KPI.
    applicable = per.select("client", "period", "case_id",
                            F.when(cid == "inflate_magnitude", F.coalesce("_has_move", F.lit(False)))
                            .when(cid == "direction_conflict_summary", F.col("_pct").isNotNull())
                            .otherwise(F.lit(True)).alias("applicable"))
    return p, d.drop("case_id", "expected_code"), comm, applicable


def coverage(pair: DataFrame, delta: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per case: reports, applicable reports, caught, holes (expected code not raised)."""
    p, d, comm, applicable = mutated_inputs(pair, delta)
    p = p.drop("case_id", "expected_code")
    flags = G.run_gate(p, d, comm, defaults, static_fallback=STATIC_THRESHOLD_PCT)
    expected = applicable.select("client", "period", "case_id", "applicable",
                                 F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c, _ in CASES]),
                                                                F.array(*[F.lit(x) for _, x in CASES])),
                                              F.col("case_id")).alias("code"))
    caught = expected.join(flags.select("client", "period", "code").distinct(), ["client", "period", "code"], "left_semi") \
        .select("client", "period", "case_id", F.lit(True).alias("_caught"))
    j = expected.join(caught, ["client", "period", "case_id"], "left")
    return j.groupBy("case_id", F.col("code").alias("expected_code")).agg(
        F.count(F.lit(1)).alias("reports"), F.count_if("applicable").alias("applicable"),
        F.count_if(F.col("applicable") & F.coalesce("_caught", F.lit(False))).alias("caught"),
        F.count_if(F.col("applicable") & ~F.coalesce("_caught", F.lit(False))).alias("holes"))
