"""Seven-criterion clean month, six-month rolling eligibility and earliest eligibility.

One aggregate over the audit log per (client, month), one semi-join for
corrections, a dense month spine per client, one window over the spine
(at most one row per month per client).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.snapshot import period_start

WINDOW_MONTHS = 6  # fixed: consecutive clean months needed


def _has_code(code: str):
    return F.exists(F.coalesce(F.col("gate_flags"), F.array().cast("array<struct<severity:string,code:string,message:string>>")),
                    lambda f: f["code"] == code)


def clean_months(audit: DataFrame, corrections: DataFrame, until: str | None = None) -> DataFrame:
    """clean_month(client_name, period, delivered_reports, corrections_count, blocker_count, failed, is_clean).

    Months run from a client's first entry to its last, or to ``until`` (yyyy-MM) if that is later: months after the last
    entry had no delivered report and are not clean.
    """
    a = audit.withColumn("_delivered", F.coalesce(F.col("delivery"), F.lit("")).startswith("email:"))
    delivered_ids = a.where("_delivered").select("client_name", "period", "report_id").distinct()
    corr = (corrections.select("report_id").join(delivered_ids, "report_id")
            .groupBy("client_name", "period").agg(F.count(F.lit(1)).alias("corrections_count")))
    nondet = (a.where(~F.col("late_correction")).groupBy("client_name", "period", "source_data_hash")
              .agg(F.countDistinct("response_hash").alias("_nr"))
              .groupBy("client_name", "period").agg(F.count_if(F.col("_nr") > 1).alias("_nondet")))
    per = a.groupBy("client_name", "period").agg(
        F.count_if("_delivered").alias("delivered_reports"),
        F.count_if(F.col("_delivered") & ~F.col("gate_passed")).alias("blocker_count"),
        F.count_if(F.col("_delivered") & ~F.col("schema_drift_clean")).alias("_drift"),
        F.count_if("late_correction").alias("_late"),
        F.count_if(F.col("_delivered") & _has_code("GOLDEN_SUITE_UNSIGNED")).alias("_unsigned"),
        F.count_if(F.col("_delivered") & _has_code("FALLBACK_COMMENTARY")).alias("_fallback"))
    bounds = a.groupBy("client_name").agg(F.min(period_start()).alias("_lo"), F.max(period_start()).alias("_hi")).where("_lo IS NOT NULL")
    if until is not None:
        bounds = bounds.withColumn("_hi", F.greatest("_hi", F.to_date(F.lit(f"{until}-01"))))
    spine = bounds.select("client_name", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("_m")) \
        .select("client_name", F.date_format("_m", "yyyy-MM").alias("period"))
    j = (spine.join(per, ["client_name", "period"], "left").join(corr, ["client_name", "period"], "left")
         .join(nondet, ["client_name", "period"], "left").na.fill(0))
    failed = F.array_compact(F.array(
        F.when(F.col("blocker_count") > 0, F.lit("C1")), F.when(F.col("corrections_count") > 0, F.lit("C2")),
        F.when(F.col("_drift") > 0, F.lit("C3")), F.when(F.col("_late") > 0, F.lit("C4_late")),
        F.when(F.col("_nondet") > 0, F.lit("C4_nondeterministic")),
        F.when(F.col("delivered_reports") == 0, F.lit("C5")), F.when(F.col("_unsigned") > 0, F.lit("C6")),
        F.when(F.col("_fallback") > 0, F.lit("C7"))))
    return j.select("client_name", "period", F.col("delivered_reports").cast("long").alias("delivered_reports"),
                    F.col("corrections_count").cast("long").alias("corrections_count"),
                    F.col("blocker_count").cast("long").alias("blocker_count"),
                    F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("is_clean"))


LISTED_IDS = 3  # fixed: report ids named per failed criterion


def criterion_details(audit: DataFrame, corrections: DataFrame, listed: int = LISTED_IDS) -> DataFrame:
    """(client_name, period, criterion, n, report_ids): why a month failed, one row per failed criterion.

    ``n`` counts the offending entries (C4_nondeterministic: source hashes with
    more than one response hash); ``report_ids`` names the first ``listed`` of
    them in log order for C1, C2 and C4_late, as the checker's message does.
    The first-k is a ``row_number <= k`` filter (a window group limit, partial
    before the shuffle), so a month with very many reports never gathers its
    ids in one task; only k ids per group are ever collected.
    """
    keys = ["client_name", "period"]
    a = audit.withColumn("_dl", F.coalesce(F.col("delivery"), F.lit("")).startswith("email:"))

    def ev(df, criterion, o1, o2):
        return df.select(*keys, F.lit(criterion).alias("criterion"), "report_id",
                         F.col(o1).cast("string").alias("_o1"), F.col(o2).cast("long").alias("_o2"))

    delivered_ids = a.where("_dl").select(*keys, "report_id").distinct()
    corr = corrections.select("report_id", "logged_at", F.lit(0).alias("_z")).join(delivered_ids, "report_id")
    events = (ev(a.where(F.col("_dl") & ~F.col("gate_passed")), "C1", "generated_at", "seq")
              .unionByName(ev(corr, "C2", "logged_at", "_z"))
              .unionByName(ev(a.where(F.col("_dl") & ~F.col("schema_drift_clean")), "C3", "generated_at", "seq"))
              .unionByName(ev(a.where("late_correction"), "C4_late", "generated_at", "seq"))
              .unionByName(ev(a.where(F.col("_dl") & _has_code("GOLDEN_SUITE_UNSIGNED")), "C6", "generated_at", "seq"))
              .unionByName(ev(a.where(F.col("_dl") & _has_code("FALLBACK_COMMENTARY")), "C7", "generated_at", "seq")))
    counts = events.groupBy(*keys, "criterion").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "criterion").orderBy("_o1", "_o2", "report_id")
    first = (events.where(F.col("criterion").isin("C1", "C2", "C4_late"))
             .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= listed)
             .groupBy(*keys, "criterion")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "report_id"))),
                                           lambda x: x["report_id"]), ", ").alias("report_ids")))
    nondet = (a.where(~F.col("late_correction")).groupBy(*keys, "source_data_hash")
              .agg(F.countDistinct("response_hash").alias("_nr")).where(F.col("_nr") > 1)
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("criterion", F.lit("C4_nondeterministic")))
    out = counts.join(first, [*keys, "criterion"], "left").unionByName(nondet, allowMissingColumns=True)
    return out.select(*keys, "criterion", F.col("n").cast("long").alias("n"),
                      F.coalesce(F.col("report_ids"), F.lit("")).alias("report_ids"))


def rolling_eligibility(clean: DataFrame, months: int = WINDOW_MONTHS) -> DataFrame:
    """For every anchor month (spine month + 1): the ``months`` months before it must all be clean."""
    w = Window.partitionBy("client_name").orderBy("period").rowsBetween(-(months - 1), 0)
    r = clean.select("client_name", "period",
                     F.sum(F.col("is_clean").cast("int")).over(w).alias("clean_in_window"),
                     F.count(F.lit(1)).over(w).alias("_n"))
    eligible = (F.col("clean_in_window") == months) & (F.col("_n") == months)
    return r.select("client_name", F.date_format(F.add_months(period_start(), 1), "yyyy-MM").alias("anchor_month"),
                    F.col("clean_in_window").cast("long").alias("clean_in_window"), eligible.alias("eligible"),
                    F.when(eligible, "Spot-Check").otherwise("Reviewed").alias("tier"))


def eligibility_at(audit: DataFrame, corrections: DataFrame, anchor_month: str, months: int = WINDOW_MONTHS) -> DataFrame:
    """Eligibility of every client at one anchor month (yyyy-MM): the ``months`` months before it must all be clean."""
    y, m = map(int, anchor_month.split("-"))
    last = f"{y - (m == 1):04d}-{(m - 2) % 12 + 1:02d}"
    return rolling_eligibility(clean_months(audit, corrections, until=last), months).where(F.col("anchor_month") == anchor_month)


def earliest_eligibility(clean: DataFrame, months: int = WINDOW_MONTHS) -> DataFrame:
    """Earliest month whose window ends clean: last dirty month + ``months`` (or first month + months - 1)."""
    g = clean.groupBy("client_name").agg(
        F.max(F.when(~F.col("is_clean"), period_start())).alias("_dirty"), F.min(period_start()).alias("_first"))
    end = F.when(F.col("_dirty").isNull(), F.add_months("_first", months - 1)).otherwise(F.add_months("_dirty", months))
    return g.select("client_name", F.date_format("_dirty", "yyyy-MM").alias("last_dirty_month"),
                    F.date_format(end, "yyyy-MM").alias("window_end_month"), F.last_day(end).alias("earliest_date"))
