"""Review gate: every check is a DataFrame -> flags DataFrame, keyed by (client, period).

``flag(client, period, gate_check, code, severity, subject, metric)``. The gate is
the union of all checks; the result per report is an aggregate over it.
Nothing loops over clients: one job checks every report at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import direction_from_pct, is_round_number
from . import reconcile as R
from . import synonyms as S
from .joins import broadcast_if_small
from .volatility import STATIC_FALLBACK_PCT

FLAG_COLS = ("client", "period", "gate_check", "code", "severity", "subject", "metric")

# Fixed values (parity with the reference).
ROW_DROP_RATIO, ROW_LOW_RATIO, ROW_SPIKE_RATIO = 0.70, 0.85, 1.5
DAYS_BLOCK, DAYS_WARN = 7, 2
WARN_SHARE_OF_THRESHOLD = 0.6
MAGNITUDE_TOLERANCE_PP = 2.0
UP_WORDS = r"\b(grew|increased|up|higher|rose|gain)\b"
DOWN_WORDS = r"\b(fell|declined|dropped|down|lower|decrease|loss)\b"
DIRECTION_KPI_WORDS = ("revenue", "sales", "amount")
FALLBACK_MARKER = "[AI UNAVAILABLE"


def _flag(df: DataFrame, check: str, code: Column, severity: Column, subject: Column, metric: Column) -> DataFrame:
    return df.select("client", "period", F.lit(check).alias("gate_check"), code.alias("code"),
                     severity.alias("severity"), subject.cast("string").alias("subject"),
                     metric.cast("double").alias("metric"))


def _when_code(*cases):
    code = sev = None
    for cond, c, s in cases:
        code = F.when(cond, F.lit(c)) if code is None else code.when(cond, F.lit(c))
        sev = F.when(cond, F.lit(s)) if sev is None else sev.when(cond, F.lit(s))
    return code, sev


# ---------------------------------------------------------------- data checks

def row_count_flags(pair: DataFrame) -> DataFrame:
    """ROW_COUNT_DROP (<0.70 block), ROW_COUNT_LOW (<0.85 warn), ROW_COUNT_SPIKE (>1.5 warn)."""
    p = pair.where((F.col("row_count") > 0) & (F.col("prev_row_count") > 0)) \
        .withColumn("_r", F.col("row_count") / F.col("prev_row_count"))
    code, sev = _when_code((F.col("_r") < ROW_DROP_RATIO, "ROW_COUNT_DROP", "block"),
                           (F.col("_r") < ROW_LOW_RATIO, "ROW_COUNT_LOW", "warn"),
                           (F.col("_r") > ROW_SPIKE_RATIO, "ROW_COUNT_SPIKE", "warn"))
    return _flag(p, "row_count", code, sev, F.lit(""), F.col("_r")).where("code IS NOT NULL")


def period_length_flags(pair: DataFrame) -> DataFrame:
    """PERIOD_LENGTH_MISMATCH: block at >= 7 days difference, warn at >= 2."""
    p = pair.where((F.col("period_days") > 0) & (F.col("prev_period_days") > 0)) \
        .withColumn("_d", F.abs(F.col("period_days") - F.col("prev_period_days")))
    sev = F.when(F.col("_d") >= DAYS_BLOCK, "block").when(F.col("_d") >= DAYS_WARN, "warn")
    return _flag(p, "period_length", F.lit("PERIOD_LENGTH_MISMATCH"), sev, F.lit(""), F.col("_d")) \
        .where("severity IS NOT NULL")


def delta_flags(delta: DataFrame, threshold: DataFrame | None = None,
                static_fallback: float = STATIC_FALLBACK_PCT) -> DataFrame:
    """ANOMALOUS_DELTA (|pct| >= threshold, block), NOTABLE_DELTA (>= 0.6 x threshold, warn).

    The threshold table is one row per (client, kpi): broadcast when its
    estimate is small, else a shuffled join.
    """
    d = delta
    if threshold is not None:
        d = d.join(broadcast_if_small(threshold.select("client", "kpi", "threshold_pct")), ["client", "kpi"], "left")
        t = F.coalesce(F.col("threshold_pct"), F.lit(static_fallback))
    else:
        t = F.lit(static_fallback)
    a = F.abs("pct")
    code, sev = _when_code((a >= t, "ANOMALOUS_DELTA", "block"),
                           (a >= t * WARN_SHARE_OF_THRESHOLD, "NOTABLE_DELTA", "warn"))
    return _flag(d, "delta", code, sev, F.col("kpi"), F.col("pct")).where("code IS NOT NULL")


def round_number_flags(delta: DataFrame) -> DataFrame:
    """ROUND_NUMBER (warn) for a current or previous value that prints as 0.0/100.0/1000.0/10000.0."""
    long = delta.select("client", "period", "kpi", "kpi_ord",
                        F.inline(F.array(F.struct(F.lit("current").alias("label"), F.col("current").alias("v")),
                                         F.struct(F.lit("previous").alias("label"), F.col("previous").alias("v")))))
    long = long.where(is_round_number(F.col("v")))
    return _flag(long, "round_number", F.lit("ROUND_NUMBER"), F.lit("warn"),
                 F.concat("kpi", F.lit(":"), "label"), F.col("v"))


# ---------------------------------------------------------------- commentary checks

def finding_rows(commentary: DataFrame) -> DataFrame:
    """One row per key finding: (client, period, idx, kpi_id, direction, magnitude_pct, context)."""
    return commentary.select("client", "period", F.posexplode("key_findings").alias("idx", "f")).select(
        "client", "period", F.col("idx").cast("int").alias("idx"),
        F.coalesce(F.col("f.kpi_id"), F.lit("")).alias("kpi_id"), F.col("f.direction").alias("direction"),
        F.col("f.magnitude_pct").alias("magnitude_pct"), F.col("f.context").alias("context"))


def _finding_subject(idx: Column) -> Column:
    return F.concat(F.lit("key_finding["), idx.cast("string"), F.lit("]"))


def findings_flags(commentary: DataFrame, delta: DataFrame, flat_band: float = 3.0) -> DataFrame:
    """MALFORMED_FINDING, UNKNOWN_KPI, FINDING_DIRECTION_MISMATCH, FINDING_MAGNITUDE_MISMATCH, NO_FINDINGS."""
    f = finding_rows(commentary)
    subj = _finding_subject(F.col("idx"))
    malformed = _flag(f.where(F.col("kpi_id") == ""), "findings", F.lit("MALFORMED_FINDING"), F.lit("block"),
                      subj, F.lit(None))
    named = f.where(F.col("kpi_id") != "")
    keys = delta.select("client", "period", F.col("kpi").alias("kpi_id"), "pct")
    unknown = _flag(named.join(keys, ["client", "period", "kpi_id"], "left_anti"), "findings",
                    F.lit("UNKNOWN_KPI"), F.lit("block"), subj, F.lit(None))
    known = named.join(keys, ["client", "period", "kpi_id"])
    src_dir = direction_from_pct(F.col("pct"), flat_band)
    direction = _flag(known.where(F.col("direction") != src_dir), "findings", F.lit("FINDING_DIRECTION_MISMATCH"),
                      F.lit("block"), subj, F.col("pct"))
    dev = F.abs(F.col("magnitude_pct") - F.abs("pct"))
    magnitude = _flag(known.where((F.col("direction") != "flat") & (dev > MAGNITUDE_TOLERANCE_PP)), "findings",
                      F.lit("FINDING_MAGNITUDE_MISMATCH"), F.lit("block"), subj, dev)
    empty = _flag(commentary.where(F.coalesce(F.size("key_findings"), F.lit(0)) <= 0), "findings", F.lit("NO_FINDINGS"), F.lit("warn"),
                  F.lit(""), F.lit(None))
    return malformed.unionByName(unknown).unionByName(direction).unionByName(magnitude).unionByName(empty)


def leak_rows(commentary: DataFrame, delta: DataFrame, defaults: DataFrame,
              overrides: DataFrame | None = None) -> DataFrame:
    """(client, period, idx, kpi_id, leaked) for findings of known KPIs with a non-empty context."""
    f = finding_rows(commentary).where((F.col("kpi_id") != "") & (F.coalesce(F.col("context"), F.lit("")) != ""))
    f = f.join(delta.select("client", "period", F.col("kpi").alias("kpi_id")), ["client", "period", "kpi_id"], "left_semi")
    return S.leaks(f, delta.select("client", "period", "kpi"), defaults, overrides)


def leak_flags(commentary: DataFrame, delta: DataFrame, defaults: DataFrame,
               overrides: DataFrame | None = None) -> DataFrame:
    lk = leak_rows(commentary, delta, defaults, overrides)
    return _flag(lk, "findings", F.lit("CONTEXT_KPI_LEAK"), F.lit("block"), _finding_subject(F.col("idx")),
                 F.lit(None))


def prose(commentary: DataFrame) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col("headline"), F.lit("")),
                       F.coalesce(F.col("executive_summary"), F.lit("")))


def number_flags(commentary: DataFrame, delta: DataFrame) -> DataFrame:
    nums = R.extract_numbers(commentary.select("client", "period", prose(commentary).alias("_t")), "_t")
    return R.reconciliation_flags(nums, delta).select(*FLAG_COLS)


def citation_flags(commentary: DataFrame) -> DataFrame:
    """NO_CITATIONS (0 claims, block), WEAK_CITATION (1 claim, warn)."""
    n = F.coalesce(F.size("rca.claims"), F.lit(0))
    c = commentary.withColumn("_n", F.when(n < 0, 0).otherwise(n))
    code, sev = _when_code((F.col("_n") == 0, "NO_CITATIONS", "block"), (F.col("_n") < 2, "WEAK_CITATION", "warn"))
    return _flag(c, "citations", code, sev, F.lit(""), F.col("_n")).where("code IS NOT NULL")


def direction_conflict_flags(commentary: DataFrame, delta: DataFrame) -> DataFrame:
    """DIRECTION_CONFLICT per revenue/sales/amount KPI when the prose uses only the opposite direction words."""
    t = commentary.select("client", "period", F.lower(prose(commentary)).alias("_t"))
    t = t.select("client", "period", F.col("_t").rlike(UP_WORDS).alias("_grew"),
                 F.col("_t").rlike(DOWN_WORDS).alias("_fell"))
    cond = F.lit(False)
    for w in DIRECTION_KPI_WORDS:
        cond = cond | F.col("kpi").contains(w)
    d = delta.where(cond).join(t, ["client", "period"])
    up = F.col("pct") > 0
    hit = (up & F.col("_fell") & ~F.col("_grew")) | (~up & F.col("_grew") & ~F.col("_fell"))
    return _flag(d.where(hit), "direction", F.lit("DIRECTION_CONFLICT"), F.lit("block"), F.col("kpi"), F.col("pct"))


def fallback_flags(commentary: DataFrame) -> DataFrame:
    c = commentary.where(F.coalesce(F.col("headline"), F.lit("")).contains(FALLBACK_MARKER))
    return _flag(c, "fallback", F.lit("FALLBACK_COMMENTARY"), F.lit("block"), F.lit(""), F.lit(None))


def missing_commentary_flags(reports: DataFrame, commentary: DataFrame) -> DataFrame:
    """NO_COMMENTARY (block) for a report that has no commentary row: it must not pass for want of anything to check."""
    bare = reports.select("client", "period").distinct().join(commentary.select("client", "period"), ["client", "period"], "left_anti")
    return _flag(bare, "commentary", F.lit("NO_COMMENTARY"), F.lit("block"), F.lit(""), F.lit(None))


# ---------------------------------------------------------------- whole gate

def run_gate(pair: DataFrame, delta: DataFrame, commentary: DataFrame, defaults: DataFrame,
             threshold: DataFrame | None = None, overrides: DataFrame | None = None,
             static_fallback: float = STATIC_FALLBACK_PCT) -> DataFrame:
    """Union of all checks, in the reference's order, and of reports that have no commentary at all."""
    parts = [missing_commentary_flags(delta, commentary), row_count_flags(pair), period_length_flags(pair), delta_flags(delta, threshold, static_fallback),
             findings_flags(commentary, delta), leak_flags(commentary, delta, defaults, overrides),
             number_flags(commentary, delta), citation_flags(commentary),
             direction_conflict_flags(commentary, delta), round_number_flags(delta), fallback_flags(commentary)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate_result(flags: DataFrame, reports: DataFrame) -> DataFrame:
    """Per report: passed, blocker/warning counts and sorted code lists (reports with no flag pass)."""
    agg = flags.groupBy("client", "period").agg(
        F.count_if(F.col("severity") == "block").alias("n_blockers"),
        F.count_if(F.col("severity") == "warn").alias("n_warnings"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == "block", F.col("code")))), ",")
         .alias("blockers"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == "warn", F.col("code")))), ",")
         .alias("warnings"))
    r = reports.select("client", "period").distinct().join(agg, ["client", "period"], "left")
    return r.select("client", "period",
                    (F.coalesce(F.col("n_blockers"), F.lit(0)) == 0).alias("passed"),
                    F.coalesce(F.col("n_blockers"), F.lit(0)).cast("long").alias("n_blockers"),
                    F.coalesce(F.col("n_warnings"), F.lit(0)).cast("long").alias("n_warnings"),
                    F.coalesce(F.col("blockers"), F.lit("")).alias("blockers"),
                    F.coalesce(F.col("warnings"), F.lit("")).alias("warnings"))
