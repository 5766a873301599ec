"""BI measures evaluated as Spark jobs: totals, ratios, MoM, YoY, YTD, running totals,
shares, top-k, filtered measures, calendar and role-playing dates.

Time-intelligence measures work on a *monthly aggregate* over a dense month
spine per series (client [, dim]): the windows then hold at most one row per
month, never fact rows, so a hot client costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small
from .ranking import rank_desc
from .snapshot import period_start


def monthly(fact: DataFrame, value: Column, series: Sequence[str] = ("client",),
            name: str = "value") -> DataFrame:
    """sum(value) per series and month (map-side partial aggregate before the shuffle)."""
    return fact.groupBy(*series, "period").agg(F.sum(value).alias(name))


def month_spine(m: DataFrame, series: Sequence[str] = ("client",)) -> DataFrame:
    """Every month between a series' first and last month, joined to its values (gaps = NULL)."""
    bounds = m.groupBy(*series).agg(F.min(period_start()).alias("_lo"), F.max(period_start()).alias("_hi"))
    spine = bounds.select(*series, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("_ms"))
    spine = spine.select(*series, F.date_format("_ms", "yyyy-MM").alias("period"))
    return spine.join(m, [*series, "period"], "left")


def _pct_change(cur: Column, prev: Column) -> Column:
    return F.when(prev.isNull() | (prev == 0), F.lit(None).cast("double")).otherwise((cur - prev) / prev * 100)


def period_over_period(m: DataFrame, lag_months: int, series: Sequence[str] = ("client",),
                       value: str = "value") -> DataFrame:
    """MoM (lag 1) or YoY (lag 12) on the dense spine; previous/pct NULL where a month is missing."""
    sp = month_spine(m, series).withColumn("_v", F.col(value).cast("double"))
    w = Window.partitionBy(*series).orderBy("period")
    prev = F.lag("_v", lag_months).over(w)
    return sp.select(*series, "period", F.col("_v").alias("current"), prev.alias("previous"),
                     _pct_change(F.col("_v"), prev).alias("pct"))


def year_to_date(m: DataFrame, series: Sequence[str] = ("client",), value: str = "value") -> DataFrame:
    w = (Window.partitionBy(*series, F.substring("period", 1, 4)).orderBy("period")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.select(*series, "period", F.col(value).cast("double").alias("value"),
                    F.sum(value).over(w).cast("double").alias("ytd"))


def running_total(m: DataFrame, series: Sequence[str] = ("client",), value: str = "value") -> DataFrame:
    w = Window.partitionBy(*series).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select(*series, "period", F.col(value).cast("double").alias("value"),
                    F.sum(value).over(w).cast("double").alias("running_total"))


def safe_ratio(num: Column, den: Column) -> Column:
    """``DIVIDE(n, d, 0)``: 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def share_of_total(agg: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """value / total: grand total (``ALL``) when ``within`` is empty, else per group (``ALLEXCEPT``).

    Totals come from an aggregate joined back (a scalar subquery for the
    grand total), not from a window over the whole group.
    """
    if not within:
        total = agg.select(F.sum(value).alias("_t"))
        return agg.withColumn("share", F.col(value).cast("double") / total.scalar().cast("double"))
    totals = agg.groupBy(*within).agg(F.sum(value).alias("_t"))
    return (agg.join(broadcast_if_small(totals), list(within))
            .withColumn("share", F.col(value).cast("double") / F.col("_t").cast("double")).drop("_t"))


def top_k(agg: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """row_number <= k per group; planned as a window group limit (partial top-k before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return agg.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def performance(agg: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Total, share of the group total and exact rank within the group (no per-group task)."""
    shared = share_of_total(agg, value, group)
    return rank_desc(shared, group, value, "rank")


def calendar(dates: DataFrame, col: str) -> DataFrame:
    """Date dimension covering whole years of the dates present (Year, Month, MonthName, Quarter, YearMonth).

    The bounds come from one aggregate; years are exploded first and
    repartitioned so days are generated in parallel per year.
    """
    years = dates.select(F.year(col).alias("y")).where("y IS NOT NULL").distinct()
    b = years.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    yr = b.select(F.explode(F.sequence("lo", "hi")).alias("y")).repartition("y")
    days = yr.select(F.explode(F.sequence(F.make_date("y", F.lit(1), F.lit(1)),
                                          F.make_date("y", F.lit(12), F.lit(31)))).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"), F.quarter("date").alias("quarter"),
        F.date_format("date", "yyyy-MM").alias("year_month"))


def by_role(fact: DataFrame, value: Column, roles: dict[str, str],
            series: Sequence[str] = ("client",)) -> DataFrame:
    """Same measure grouped by each role-playing date column (``USERELATIONSHIP``)."""
    arr = F.array(*[F.struct(F.lit(r).alias("date_role"), F.date_format(c, "yyyy-MM").alias("period"))
                    for r, c in roles.items()])
    long = fact.select(*series, value.alias("_v"), F.inline(arr))
    return long.groupBy(*series, "date_role", "period").agg(F.sum("_v").cast("double").alias("value"))
