"""Nested JSON payloads per report: snapshot, prompt context, held-report packet.

Every payload is built by aggregates bounded by one report (its KPIs, its
top-10 breakdown values, its flags) and serialised with ``to_json``; nothing
is assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sanitize import sanitize
from ..functions.text import fixed
from ..operators.snapshot import top_movers


def _breakdown_maps(breakdown: DataFrame, clean_keys: bool = False) -> DataFrame:
    """(client, period, breakdowns MAP<dim, MAP<value, double>>[, redactions ARRAY<STRING>])."""
    b = breakdown
    if clean_keys:
        s = sanitize(F.col("dim_value"))
        b = b.withColumn("_s", s).withColumn(
            "_red", F.when(F.size("_s.reasons") > 0, F.concat(F.col("dim"), F.lit(".<key:"),
                                                               F.substring("dim_value", 1, 30), F.lit(">: "),
                                                               F.array_join("_s.reasons", ","))))
        b = b.withColumn("dim_value", F.col("_s.clean"))
        # values that clean to one key: the last of the breakdown's order stays, as in a map that is filled in order
        b = b.groupBy("client", "period", "dim", "dim_value").agg(
            F.max_by("value", "rnk").alias("value"), F.array_compact(F.collect_list("_red")).alias("_red"))
    per_dim = b.groupBy("client", "period", "dim").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim_value", "value")))).alias("_m"),
        *([F.flatten(F.collect_list("_red")).alias("_red")] if clean_keys else []))
    out = per_dim.groupBy("client", "period").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "_m"))).alias("breakdowns"),
        *([F.flatten(F.collect_list("_red")).alias("redactions")] if clean_keys else []))
    return out


def snapshot_json(kpi: DataFrame, snap: DataFrame, breakdown: DataFrame) -> DataFrame:
    """(client, period, json) — period, row_count, period_days, kpis, dimension_breakdowns."""
    k = kpi.groupBy("client", "period").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("kpi_ord", "kpi", "value"))),
                                       lambda x: F.struct(x["kpi"], x["value"]))).alias("kpis"))
    j = snap.join(k, ["client", "period"]).join(_breakdown_maps(breakdown), ["client", "period"], "left")
    payload = F.struct("period", "row_count", "period_days", "kpis",
                       F.col("breakdowns").alias("dimension_breakdowns"))
    return j.select("client", "period", F.to_json(payload).alias("json"))


def _days_note(cur, prev):
    diff = cur - prev
    share = fixed(F.abs(diff / F.greatest(prev, F.lit(1))) * 100)
    note = F.when(F.abs(diff) >= 2, F.concat(
        F.lit("Period length differs by "), F.abs(diff).cast("string"), F.lit(" day(s). Attribute up to "), share,
        F.lit("% of any revenue delta to period length, not business change."))).otherwise(F.lit("Period lengths match."))
    return F.when((cur > 0) & (prev > 0), F.struct(cur.alias("current_days"), prev.alias("previous_days"),
                                                   diff.alias("difference_days"), note.alias("analyst_note")))


def prompt_context(delta: DataFrame, pair: DataFrame, breakdown: DataFrame) -> DataFrame:
    """(client, period, json): deltas, top movers, both months' breakdowns (keys cleaned), period-length note."""
    d = delta.groupBy("client", "period", "prev_period").agg(
        F.map_from_entries(F.collect_list(F.struct("kpi", F.struct("current", "previous", "abs", "pct")))).alias("kpi_deltas"))
    movers = top_movers(delta, 5).groupBy("client", "period").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "kpi", "pct"))),
                    lambda x: F.struct(x["kpi"], x["pct"])).alias("top_movers"))
    bm = _breakdown_maps(breakdown, clean_keys=True)
    cur = bm.select("client", "period", F.col("breakdowns").alias("current_breakdowns"),
                    F.col("redactions").alias("_r1"))
    prev = bm.select("client", F.col("period").alias("prev_period"), F.col("breakdowns").alias("previous_breakdowns"),
                     F.col("redactions").alias("_r2"))
    j = (d.join(movers, ["client", "period"], "left").join(cur, ["client", "period"], "left")
         .join(prev, ["client", "prev_period"], "left")
         .join(pair.select("client", "period", "period_days", "prev_period_days"), ["client", "period"], "left"))
    red = F.concat(F.coalesce("_r1", F.array().cast("array<string>")), F.coalesce("_r2", F.array().cast("array<string>")))
    payload = F.struct(F.concat_ws(" vs ", "period", "prev_period").alias("period"), "kpi_deltas", "top_movers",
                       "current_breakdowns", "previous_breakdowns",
                       _days_note(F.col("period_days"), F.col("prev_period_days")).alias("period_days"),
                       F.when(F.size(red) > 0, red).alias("_sanitizer_redactions"))
    return j.select("client", "period", F.to_json(payload).alias("json"))


def held_packets(result: DataFrame, flags: DataFrame, commentary: DataFrame, delta: DataFrame) -> DataFrame:
    """(client, period, json) for reports that did not pass the gate."""
    held = result.where(~F.col("passed")).select("client", "period")
    f = flags.join(held, ["client", "period"], "left_semi").groupBy("client", "period").agg(
        F.array_sort(F.collect_list(F.when(F.col("severity") == "block", F.struct("code", "subject", "metric"))))
        .alias("blockers"),
        F.array_sort(F.collect_list(F.when(F.col("severity") == "warn", F.struct("code", "subject", "metric"))))
        .alias("warnings"))
    dl = delta.join(held, ["client", "period"], "left_semi").groupBy("client", "period", "prev_period").agg(
        F.map_from_entries(F.collect_list(F.struct("kpi", F.struct("current", "previous", "abs", "pct")))).alias("kpi_deltas"))
    c = commentary.join(held, ["client", "period"], "left_semi")
    j = f.join(dl, ["client", "period"]).join(c, ["client", "period"])
    packet = F.struct(
        F.col("client"), F.concat_ws(" vs ", "period", "prev_period").alias("period"),
        F.struct(F.lit(False).alias("passed"), "blockers", "warnings").alias("review"),
        F.struct("headline", F.col("rca.claims").alias("root_cause_claims"),
                 F.col("rca.unsupported_factors").alias("unsupported_factors"), "executive_summary").alias("commentary"),
        "kpi_deltas")
    return j.select("client", "period", F.to_json(packet).alias("json"))
