"""Monthly KPI snapshot, comparison with the previous month, movers, breakdowns.

Tables (all keyed by client and period):

* ``period_aggregate`` — one wide row per (client, period): per-measure sum,
  non-null count and max, row count, min/max of the date column. This is the
  only pass over the fact; everything else here reads this small result.
* ``kpi(client, period, kpi, kpi_ord, value)`` — total_/avg_/max_ per measure.
* ``snapshot(client, period, row_count, period_days)``
* ``kpi_delta(client, period, prev_period, kpi, kpi_ord, current, previous, abs, pct)``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("client", "period")
_KINDS = ("total", "avg", "max")
_DAY_MICROS = 86_400_000_000


def period_start(col: str = "period"):
    """First day of the month of a ``yyyy-MM`` period string; NULL if the text is no month (never raises)."""
    return F.try_to_date(F.concat(F.col(col), F.lit("-01")), "yyyy-MM-dd")


def invalid_periods(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """INVALID_PERIOD (block) for every report whose period is no month: one bad file name stops no other report."""
    return (df.select(*keys).distinct().where(period_start().isNull())
            .select(*keys, F.lit("INVALID_PERIOD").alias("code"), F.lit("block").alias("severity"),
                    F.concat(F.lit("Period '"), F.coalesce("period", F.lit("")), F.lit("' is not a month (yyyy-MM).")).alias("message")))


def period_aggregate(fact: DataFrame, measures: Sequence[str], date_col: str | None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """One hash aggregate over the fact (partial on the map side, final after the shuffle)."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for m in measures:
        aggs += [F.sum(m).alias(f"_sum_{m}"), F.count(m).alias(f"_cnt_{m}"), F.max(m).alias(f"_max_{m}")]
    if date_col:
        aggs += [F.min(date_col).alias("_min_ts"), F.max(date_col).alias("_max_ts")]
    return fact.groupBy(*keys).agg(*aggs)


def kpis_from_aggregate(agg: DataFrame, measures: Sequence[str],
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Unpivot the (small) aggregate into KPI rows; all-null measures give none."""
    rows = []
    for i, m in enumerate(measures):
        s, c, mx = F.col(f"_sum_{m}"), F.col(f"_cnt_{m}"), F.col(f"_max_{m}")
        vals = (s.cast("double"), s.cast("double") / c, mx.cast("double"))
        for j, (kind, v) in enumerate(zip(_KINDS, vals)):
            rows.append(F.struct(F.lit(f"{kind}_{m}").alias("kpi"), F.lit(i * 3 + j + 1).alias("kpi_ord"),
                                 v.alias("value"), (c > 0).alias("_present")))
    return (agg.select(*keys, F.inline(F.array(*rows)))
            .where("_present").drop("_present"))


def kpi_table(fact: DataFrame, measures: Sequence[str], date_col: str | None = None,
              keys: Sequence[str] = KEYS) -> DataFrame:
    return kpis_from_aggregate(period_aggregate(fact, measures, date_col, keys), measures, keys)


def snapshot_from_aggregate(agg: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Row count and covered days (whole days between first and last date, plus one)."""
    if "_min_ts" in agg.columns:
        span = (F.unix_micros(F.col("_max_ts").cast("timestamp"))
                - F.unix_micros(F.col("_min_ts").cast("timestamp")))
        days = F.coalesce((F.floor(span / F.lit(_DAY_MICROS)) + 1).cast("long"), F.lit(0).cast("long"))
    else:
        days = F.lit(0).cast("long")
    return agg.select(*keys, F.col("row_count").cast("long").alias("row_count"), days.alias("period_days"))


def snapshot_table(fact: DataFrame, date_col: str | None, keys: Sequence[str] = KEYS) -> DataFrame:
    return snapshot_from_aggregate(period_aggregate(fact, [], date_col, keys), keys)


def previous_period(months_back: int = 1):
    return F.date_format(F.add_months(period_start(), -months_back), "yyyy-MM")


def kpi_delta(kpi: DataFrame, months_back: int = 1, pairs: DataFrame | None = None) -> DataFrame:
    """Current vs previous calendar month (or an explicit ``pairs(client, period, prev_period)``).

    Equi-join, not ``lag``: a missing month gives no comparison. pct is 0 when
    previous is 0.
    """
    cur = kpi.select("client", "period", "kpi", "kpi_ord", F.col("value").alias("current"))
    if pairs is None:
        cur = cur.withColumn("prev_period", previous_period(months_back))
    else:
        cur = cur.join(pairs, ["client", "period"])
    prev = kpi.select("client", F.col("period").alias("prev_period"), "kpi", F.col("value").alias("previous"))
    d = cur.join(prev, ["client", "prev_period", "kpi"])
    diff = F.col("current") - F.col("previous")
    return d.select(
        "client", "period", "prev_period", "kpi", "kpi_ord", "current", "previous",
        diff.alias("abs"),
        F.when(F.col("previous") == 0, F.lit(0.0)).otherwise(diff / F.col("previous") * 100).alias("pct"))


def snapshot_pair(snap: DataFrame, months_back: int = 1) -> DataFrame:
    """Current and previous snapshot side by side (feeds row-count and period-length checks)."""
    cur = snap.withColumn("prev_period", previous_period(months_back))
    prev = snap.select("client", F.col("period").alias("prev_period"),
                       F.col("row_count").alias("prev_row_count"),
                       F.col("period_days").alias("prev_period_days"))
    return cur.join(prev, ["client", "prev_period"])


def top_movers(delta: DataFrame, n: int = 5) -> DataFrame:
    """Top n KPIs by |pct| per (client, period); ties by KPI order (planned as a group limit)."""
    w = Window.partitionBy("client", "period").orderBy(F.abs("pct").desc(), "kpi_ord")
    return (delta.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("client", "period", "rank", "kpi", "pct"))


def breakdown(fact: DataFrame, dims: Sequence[str], measure: str, top: int = 10,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of the first measure by each dimension value, top ``top`` per dimension.

    The fact is first summed by all dimensions together; only these sums, far
    fewer than the fact's rows, are unpivoted to (dim, dim_value) and summed
    again, so that the fact's rows are never multiplied. Null
    keys are dropped; an all-null group sums to 0. Top-k is a window group
    limit (partial top-k before the shuffle, so a hot group never piles up).
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("dim_value"))
                      for d in dims])
    base = fact.groupBy(*keys, *dims).agg(F.sum(measure).alias("_m"))
    long = base.select(*keys, "_m", F.inline(pairs)).where(F.col("dim_value").isNotNull())
    agg = long.groupBy(*keys, "dim", "dim_value").agg(
        F.coalesce(F.sum("_m"), F.lit(0)).cast("double").alias("value"))
    w = Window.partitionBy(*keys, "dim").orderBy(F.col("value").desc(), F.col("dim_value"))
    return agg.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= top)
