"""Per-KPI alert thresholds from the history of monthly deltas (median + MAD).

threshold = max(|median| + n_sigma * 1.4826 * MAD, 5), rounded to 0.1.
A client with fewer than ``min_history`` recorded periods gets no profile
(the gate then uses the static fallback for every KPI); a KPI with fewer
points gets ``static_fallback``.

All aggregates are per (client, kpi): bounded by the number of months, not
by fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (must equal the reference's defaults).
STATIC_FALLBACK_PCT = 15.0
MIN_HISTORY = 3
N_SIGMA = 2.5
MAD_CONSISTENCY = 1.4826
FLOOR_PCT = 5.0


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Last write wins per key (``order`` sorts newest first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def history_from_deltas(delta: DataFrame) -> DataFrame:
    """history(client, period, kpi, pct): the record written for each report."""
    return delta.select("client", "period", "kpi", "pct")


def thresholds(history: DataFrame, n_sigma: float = N_SIGMA, min_history: int = MIN_HISTORY,
               static_fallback: float = STATIC_FALLBACK_PCT) -> DataFrame:
    """threshold(client, kpi, threshold_pct, method, history_count, median_pct, mad_pct)."""
    periods = history.groupBy("client").agg(F.countDistinct("period").alias("_np"))
    h = history.join(periods.where(F.col("_np") >= min_history), "client", "left_semi")
    med = h.groupBy("client", "kpi").agg(F.median("pct").alias("_med"), F.count("pct").alias("history_count"))
    mad = (h.join(med, ["client", "kpi"])
           .groupBy("client", "kpi", "_med", "history_count")
           .agg(F.median(F.abs(F.col("pct") - F.col("_med"))).alias("_mad")))
    sigma = F.col("_mad") * MAD_CONSISTENCY
    computed = F.greatest(F.abs("_med") + F.lit(n_sigma) * sigma, F.lit(FLOOR_PCT))
    enough = F.col("history_count") >= min_history
    return mad.select(
        "client", "kpi",
        F.when(enough, F.round(computed, 1)).otherwise(F.lit(static_fallback)).alias("threshold_pct"),
        F.when(enough, F.lit("volatility_mad")).otherwise(F.lit("static_fallback")).alias("method"),
        F.col("history_count").cast("int").alias("history_count"),
        F.when(enough, F.round("_med", 2)).otherwise(F.lit(0.0)).alias("median_pct"),
        F.when(enough, F.round(sigma, 2)).otherwise(F.lit(0.0)).alias("mad_pct"))
