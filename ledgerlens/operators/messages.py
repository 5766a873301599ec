"""Text of gate flags: what an analyst reads beside the code.

Flags are joined to the small report-level tables that their numbers come from (a row for each report, KPI or finding), so a
message costs no pass over the fact. All joins carry (client, period).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import direction_from_pct, fixed
from .gate import finding_rows
from .volatility import STATIC_FALLBACK_PCT

# Fixed values (parity with the reference): the wording of each flag's message and detail.
RATIO = "Current row count (%s) is %s%% of previous (%s)"
THRESHOLD = "threshold=%s%% (%s, n=%d)"
STATIC_THRESHOLD = "threshold=%.1f%% (static fallback — no history)"
DETAILS = {
    "ROW_COUNT_DROP": "Verify the export completed. Check file size against history before re-running.",
    "ROW_COUNT_LOW": "May be normal seasonal drop; confirm with the client.",
    "ROW_COUNT_SPIKE": "Possible duplicate ingestion or business-event spike — verify.",
    "DIRECTION_CONFLICT": "The commentary likely made the direction up.",
    "ROUND_NUMBER": "Check: percentage column misread as monetary?",
    "NO_COMMENTARY": "The report has nothing to review. Complete the narrative before delivery.",
}
PLAIN = {
    "NO_FINDINGS": "key_findings is empty — report has no headline movements",
    "NO_CITATIONS": "root_cause_analysis has zero KPI-backed claims — all factors are unsupported",
    "WEAK_CITATION": "Only 1 cited claim(s) — verify it's sufficient for the narrative",
    "FALLBACK_COMMENTARY": "Commentary is the API-unavailable fallback — do not deliver",
    "NO_COMMENTARY": "Report has no commentary",
}


def _case(by_code: dict[str, Column]) -> Column:
    out = None
    for code, text in by_code.items():
        when = F.col("code") == code
        out = F.when(when, text) if out is None else out.when(when, text)
    return out


def with_messages(flags: DataFrame, pair: DataFrame, delta: DataFrame, commentary: DataFrame, threshold: DataFrame | None = None) -> DataFrame:
    """``flags`` with ``message`` and ``detail`` ('' where a flag has none)."""
    report = ["client", "period"]
    kpi = F.regexp_extract("subject", r"^([^:\[]*)", 1)
    index = F.regexp_extract("subject", r"\[(\d+)\]$", 1).try_cast("int")
    f = flags.withColumns({"_idx": F.when(F.col("gate_check") == "findings", index)})
    sizes = pair.select(*report, "row_count", "prev_row_count", "period_days", "prev_period_days")
    named = finding_rows(commentary).select(*report, F.col("idx").alias("_idx"), "kpi_id", "direction", "magnitude_pct", "context")
    values = delta.select(*report, F.col("kpi").alias("_kpi"), "pct", "current", "previous")
    f = f.join(sizes, report, "left").join(named, [*report, "_idx"], "left")
    f = f.withColumn("_kpi", F.coalesce("kpi_id", kpi)).join(values, [*report, "_kpi"], "left")
    if threshold is not None:
        f = f.join(threshold.select("client", F.col("kpi").alias("_kpi"), "threshold_pct", "method", "history_count"), ["client", "_kpi"], "left")
    else:
        f = f.withColumns({"threshold_pct": F.lit(None).cast("double"), "method": F.lit(None).cast("string"), "history_count": F.lit(None).cast("int")})
    metric, pct, at = F.col("metric"), F.col("pct"), F.col("_idx")
    signed = lambda x: fixed(x, 1, plus=True)
    ratio = F.format_string(RATIO, F.format_number("row_count", 0), F.round(metric * 100).cast("long").cast("string"), F.format_number("prev_row_count", 0))
    limit = F.when(F.col("threshold_pct").isNull(), F.format_string(STATIC_THRESHOLD, F.lit(STATIC_FALLBACK_PCT))).otherwise(
        F.format_string(THRESHOLD, fixed(F.col("threshold_pct")), "method", "history_count"))
    current = F.col("subject").endswith(":current")
    said = F.when(pct > 0, "fell").otherwise("grew")
    message = _case({
        "ROW_COUNT_DROP": F.concat(ratio, F.lit(" — likely truncated source file")), "ROW_COUNT_LOW": ratio, "ROW_COUNT_SPIKE": ratio,
        "PERIOD_LENGTH_MISMATCH": F.format_string("Period coverage differs by %d days (current=%d, previous=%d)", metric.cast("long"), "period_days", "prev_period_days"),
        "ANOMALOUS_DELTA": F.format_string("%s changed %s%% — exceeds %s", "_kpi", signed(metric), limit),
        "NOTABLE_DELTA": F.format_string("%s changed %s%% — above 60%% of %s", "_kpi", signed(metric), limit),
        "MALFORMED_FINDING": F.format_string("key_finding[%d] has empty kpi_id — likely legacy prose format", at),
        "UNKNOWN_KPI": F.format_string("key_finding[%d] references kpi_id='%s' which is not in source data", at, "kpi_id"),
        "FINDING_DIRECTION_MISMATCH": F.format_string("key_finding[%d] for '%s' says '%s' but source pct is %s%% (direction='%s')", at, "kpi_id", "direction", signed(pct),
                                                      direction_from_pct(pct)),
        "FINDING_MAGNITUDE_MISMATCH": F.format_string("key_finding[%d] for '%s' claims %s%% but source is %s%% (delta %spp)", at, "kpi_id", fixed(F.col("magnitude_pct")), fixed(F.abs(pct)), fixed(metric)),
        "CONTEXT_KPI_LEAK": F.format_string("key_finding[%d] for '%s' mentions other KPI tokens in context", at, "kpi_id"),
        "NUMERIC_MISMATCH": F.format_string("Commentary states '%s' but the nearest source KPI deviates by %spp", "subject", fixed(metric)),
        "NUMERIC_APPROXIMATION": F.format_string("Commentary states '%s'; the nearest KPI is %spp off", "subject", fixed(metric)),
        "UNVERIFIABLE_ABSOLUTE": F.format_string("Value '%s' does not match any source KPI within 2.0%%", "subject"),
        "DIRECTION_CONFLICT": F.format_string("Commentary says revenue %s but %s is %s%%", said, "_kpi", signed(metric)),
        "ROUND_NUMBER": F.format_string("%s %s is suspiciously round (%s)", "_kpi", F.when(current, "current").otherwise("previous"), metric.cast("string")),
        **{code: F.lit(text) for code, text in PLAIN.items()}})
    share = F.format_string("~%s%% of the delta may be a length effect, not a business change. Analyst must acknowledge.",
                            fixed(metric / F.greatest("prev_period_days", F.lit(1)) * 100))
    values_text = F.format_string("Current: %s  Previous: %s", F.format_number("current", 2), F.format_number("previous", 2))
    detail = _case({
        "PERIOD_LENGTH_MISMATCH": F.when(F.col("severity") == "block", "Likely partial-month extract. Resolve before comparison.").otherwise(share),
        "ANOMALOUS_DELTA": values_text, "NOTABLE_DELTA": values_text, "MALFORMED_FINDING": F.concat(F.lit("Context: "), F.substring("context", 1, 80)),
        "CONTEXT_KPI_LEAK": F.format_string("Context: '%s' — possible label transposition", "context"),
        **{code: F.lit(text) for code, text in DETAILS.items()}})
    return f.select(*flags.columns, F.coalesce(message, F.lit("")).alias("message"), F.coalesce(detail, F.lit("")).alias("detail"))
