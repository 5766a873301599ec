"""Date-column validation for every (client, period) and candidate column in one aggregate pass.

Checks (in order, with the reference's early stops): COLUMN_NOT_FOUND,
NOT_A_DATE (< 50 % parse, stop) / DATE_NOT_PARSED, HIGH_NULL_RATE, ALL_NULL
(stop), FUTURE_DATES (> as_of + 3 days), PERIOD_MISMATCH / PARTIAL_PERIOD,
ALL_DATES_UNIQUE. ``as_of`` is a parameter — operators never read the clock.

Whether a value comes twice is told from a bitmap of the days of each column, so that the aggregate needs no row twice, as several counts of
distinct values would. Only where days repeat and times of day differ, whole values are compared, in another pass over these groups.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fixed
from ..session import ensure_checkpoint_dir
from .joins import broadcast_if_small
from .snapshot import period_start

# Fixed values (parity with the reference).
MAX_NULL_RATE = 0.05
MAX_FUTURE_DAYS = 3
MIN_PARSE_RATE = 0.5
MIN_IN_PERIOD_SHARE = 0.8
# Days that a bitmap holds, from 1970-01-01 on (to 2059); others are compared as whole values.
BITMAP_DAYS = 32768
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy",
                "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][XXX]", "yyyy/M/d", "d/M/yy", "d.M.yy", "d-M-yy")


def _shape(fmt: str) -> str:
    """A regex that every text of a format matches (and texts that are no dates too): signed digits, the signs between them, any optional end."""
    fixed_part, optional, _ = fmt.partition("[")
    digits = re.sub(r"[yMdHms]+", "n", fixed_part.replace("'T'", "T"))
    return "^" + re.escape(digits).replace("n", "[-+]?[0-9]+").replace("T", "[Tt]") + ("" if optional else "$")


def parse_date(c: Column) -> Column:
    """ISO first, then day-first formats; NULL when nothing parses (never raises).

    A format is only tried on texts of its shape: a text that a format can't read costs an exception, many times the cost of a match.
    """
    three_numbers = c.rlike(r"^[-+]?[0-9]+[-/.][-+]?[0-9]+[-/.][-+]?[0-9]+")
    return F.when(three_numbers, F.coalesce(*[F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in DATE_FORMATS]))


def _is_datetime(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def date_stats(df: DataFrame, candidates: Sequence[str], as_of: str, keys: Sequence[str] = ("client", "period"),
               parity_period_end: bool = True) -> DataFrame:
    """stats(keys, column_name, cand_ord, present, is_typed, rows, parsed, nonnull, unique, future, in_period, min_date, max_date, dtype, example).

    ``unique``: no value comes twice, nulls included. ``example`` is the smallest text of a column that is not typed as a date.
    """
    first = period_start()                                             # NULL if the period is no month
    start = F.to_timestamp(first)
    end_incl = F.to_timestamp(F.last_day(first))                       # midnight of the last day (parity)
    end_excl = F.to_timestamp(F.add_months(first, 1))
    cutoff = F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {MAX_FUTURE_DAYS} DAYS")
    aggs, structs, dated = [F.count(F.lit(1)).alias("_rows")], [], {}
    for i, c in enumerate(candidates):
        if c not in df.columns:
            structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("cand_ord"),
                                    F.lit(False).alias("present"), F.lit(True).alias("is_typed"),
                                    *[F.lit(None).cast("long").alias(n) for n in ("parsed", "nonnull", "days", "future", "in_period")],
                                    F.lit(None).cast("boolean").alias("whole_days"),
                                    *[F.lit(None).cast("timestamp").alias(n) for n in ("min_date", "max_date")],
                                    *[F.lit(None).cast("string").alias(n) for n in ("dtype", "example")]))
            continue
        typed, v = _is_datetime(df, c), F.col(f"_v{i}")
        dated[f"_v{i}"] = _as_date(df, c)
        in_p = (v >= start) & ((v <= end_incl) if parity_period_end else (v < end_excl))
        day = F.datediff(v, F.lit("1970-01-01"))
        known = day.between(0, BITMAP_DAYS - 1)
        aggs += [F.count(v).alias(f"_n{i}"), F.bitmap_count(F.bitmap_construct_agg(F.when(known, F.bitmap_bit_position(day + 1)))).alias(f"_d{i}"),
                 F.bool_and(known & (v == F.date_trunc("DAY", v))).alias(f"_w{i}"),
                 F.count_if(v > cutoff).alias(f"_f{i}"), F.count_if(in_p).alias(f"_p{i}"),
                 F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"),
                 (F.min(F.lit(None).cast("string")) if typed else F.min(F.col(c).cast("string"))).alias(f"_x{i}")]
        structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("cand_ord"),
                                F.lit(True).alias("present"), F.lit(typed).alias("is_typed"),
                                F.col(f"_n{i}").alias("parsed"), F.col(f"_n{i}").alias("nonnull"), F.col(f"_d{i}").alias("days"),
                                F.col(f"_f{i}").alias("future"), F.col(f"_p{i}").alias("in_period"), F.col(f"_w{i}").alias("whole_days"),
                                F.col(f"_lo{i}").alias("min_date"), F.col(f"_hi{i}").alias("max_date"),
                                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(f"_x{i}").alias("example")))
    ensure_checkpoint_dir(df.sparkSession)
    g = df.withColumns(dated).groupBy(*keys).agg(*aggs)
    stats = g.select(*keys, F.col("_rows").alias("rows"), F.inline(F.array(*structs)))
    few_nulls = F.col("rows") - F.col("nonnull") <= 1
    # every value on a day of its own; or else, if they are whole days, some value comes twice
    stats = stats.withColumn("unique", F.when(~few_nulls, False).when(F.col("nonnull") == F.col("days"), True).when(F.col("whole_days"), False)).checkpoint()
    open_ = stats.where("present AND unique IS NULL").select(*keys, "column_name")
    if not open_.isEmpty():
        twice = _repeated_values(df, [c for c in candidates if c in df.columns], open_, keys).checkpoint()
        stats = stats.join(broadcast_if_small(twice), [*keys, "column_name"], "left").withColumn("unique", F.coalesce("unique", F.col("_twice").isNull())).drop("_twice")
    return stats.select(*keys, "rows", "column_name", "cand_ord", "present", "is_typed", "parsed", "nonnull", "unique", "future", "in_period", "min_date", "max_date", "dtype", "example")


def _as_date(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("timestamp") if _is_datetime(df, c) else parse_date(F.col(c).cast("string"))


def _repeated_values(df: DataFrame, candidates: Sequence[str], groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column_name, _twice): those of ``groups`` in which some value comes twice."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), _as_date(df, c).alias("_v")) for c in candidates])
    long = df.join(broadcast_if_small(groups.select(*keys).distinct()), list(keys), "left_semi").select(*keys, F.inline(values)).where("_v IS NOT NULL")
    long = long.join(broadcast_if_small(groups), [*keys, "column_name"], "left_semi")
    return long.groupBy(*keys, "column_name", "_v").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, "column_name").distinct().withColumn("_twice", F.lit(True))


def date_issues(stats: DataFrame, keys: Sequence[str] = ("client", "period"),
                max_null_rate: float = MAX_NULL_RATE) -> DataFrame:
    """issue(keys, column_name, cand_ord, code, severity, metric) with the reference's early stops."""
    rows = F.col("rows")
    null_rate = F.lit(1.0) - F.col("nonnull") / F.greatest(rows, F.lit(1))
    not_date = ~F.col("is_typed") & (F.col("parsed") / F.greatest(rows, F.lit(1)) < MIN_PARSE_RATE)
    all_null = F.col("nonnull") == 0

    def ev(cond, code, sev, metric):
        return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"),
                                     metric.cast("double").alias("metric")))

    live = F.col("present") & ~not_date
    is_month = period_start().isNotNull()
    after_null = live & ~all_null
    events = F.array(
        ev(~F.col("present"), "COLUMN_NOT_FOUND", "block", F.lit(None)),
        ev(F.col("present") & not_date, "NOT_A_DATE", "block", F.col("parsed") / F.greatest(rows, F.lit(1))),
        ev(live & ~F.col("is_typed"), "DATE_NOT_PARSED", "warn", F.col("parsed") / F.greatest(rows, F.lit(1))),
        ev(live & (null_rate > max_null_rate), "HIGH_NULL_RATE", "block", null_rate),
        ev(live & all_null, "ALL_NULL", "block", F.lit(None)),
        ev(after_null & (F.col("future") > 0), "FUTURE_DATES", "warn", F.col("future")),
        ev(after_null & ~is_month, "INVALID_PERIOD", "block", F.lit(None)),
        ev(after_null & is_month & (F.col("in_period") == 0), "PERIOD_MISMATCH", "block", F.col("in_period")),
        ev(after_null & is_month & (F.col("in_period") > 0) & (F.col("in_period") < rows * MIN_IN_PERIOD_SHARE),
           "PARTIAL_PERIOD", "warn", F.col("in_period")),
        ev(after_null & F.col("unique"), "ALL_DATES_UNIQUE", "warn", F.lit(None)))
    return stats.select(*keys, "column_name", "cand_ord", F.inline(F.filter(events, lambda e: e.isNotNull())))


# Fixed values (parity with the reference): the wording of each issue's message and detail.
DATE_MESSAGES = {
    "COLUMN_NOT_FOUND": "Date column '%s' does not exist in the DataFrame",
    "NOT_A_DATE": "'%s' is %s — fewer than 50%% of values parse as dates",
    "DATE_NOT_PARSED": "'%s' is %s, coerced to datetime — confirm ingestion type detection",
    "HIGH_NULL_RATE": "%s%% of dates are null — YTD and MoM will be incorrect",
    "ALL_NULL": "All date values are null",
    "FUTURE_DATES": "%s rows have dates more than 3 days in the future",
    "PERIOD_MISMATCH": "No dates fall within expected period %s",
    "PARTIAL_PERIOD": "Only %s/%s rows fall within %s",
    "ALL_DATES_UNIQUE": "Every date is unique — this may be a summary row (one per day) rather than a transaction table",
}
DATE_DETAILS = {
    "NOT_A_DATE": "Sample values: [%s]",
    "HIGH_NULL_RATE": "%s null rows out of %s",
    "FUTURE_DATES": "Max date: %s — possible data entry error or wrong column",
    "PERIOD_MISMATCH": "Data spans %s → %s. Wrong file?",
    "PARTIAL_PERIOD": "Partial month? Check if data is complete.",
    "ALL_DATES_UNIQUE": "PREVIOUSMONTH / DATEADD work correctly, but verify grain matches your DAX.",
}


def date_messages(issues: DataFrame, stats: DataFrame, keys: Sequence[str] = ("client", "period")) -> DataFrame:
    """``issues`` with ``message`` and ``detail`` ('' where an issue has none), and the column's ``min_date`` and ``max_date``.

    A type is named as the engine names it, and one sample is shown: the smallest text.
    """
    facts = stats.select(*keys, "column_name", "rows", "nonnull", "dtype", "example", F.to_date("min_date").alias("min_date"), F.to_date("max_date").alias("max_date"))
    j = issues.join(facts, [*keys, "column_name"], "left")
    rate = F.lit(1.0) - F.col("nonnull") / F.greatest("rows", F.lit(1))
    count = F.col("metric").cast("long").cast("string")
    period = F.col("period") if "period" in keys else F.lit("")
    args = {"COLUMN_NOT_FOUND": ["column_name"], "NOT_A_DATE": ["column_name", "dtype"], "DATE_NOT_PARSED": ["column_name", "dtype"], "HIGH_NULL_RATE": [fixed(rate * 100)],
            "FUTURE_DATES": [count], "PERIOD_MISMATCH": [period], "PARTIAL_PERIOD": [count, F.col("rows").cast("string"), period]}
    details = {"NOT_A_DATE": [F.coalesce(F.concat(F.lit("'"), "example", F.lit("'")), F.lit(""))], "HIGH_NULL_RATE": [F.floor(rate * F.col("rows")).cast("string"), F.col("rows").cast("string")],
               "FUTURE_DATES": [F.col("max_date").cast("string")], "PERIOD_MISMATCH": [F.col("min_date").cast("string"), F.col("max_date").cast("string")]}

    def worded(texts: dict[str, str], filled: dict) -> Column:
        out = F.lit("")
        for code, text in texts.items():
            out = F.when(F.col("code") == code, F.format_string(text, *filled[code]) if code in filled else F.lit(text)).otherwise(out)
        return out

    return j.select(*keys, "column_name", "cand_ord", "code", "severity", "metric", worded(DATE_MESSAGES, args).alias("message"),
                    worded(DATE_DETAILS, details).alias("detail"), "min_date", "max_date")


def date_summary(stats: DataFrame, issues: DataFrame, keys: Sequence[str] = ("client", "period")) -> DataFrame:
    """Per (keys, column): passed (no blocker), blocker count, null rate, min/max date."""
    b = issues.groupBy(*keys, "column_name").agg(F.count_if(F.col("severity") == "block").alias("n_blockers"))
    s = stats.join(b, [*keys, "column_name"], "left")
    nb = F.coalesce(F.col("n_blockers"), F.lit(0)).cast("long")
    return s.select(*keys, "column_name", "cand_ord", (nb == 0).alias("passed"), nb.alias("n_blockers"),
                    (F.lit(1.0) - F.col("nonnull") / F.greatest(F.col("rows"), F.lit(1))).alias("null_rate"),
                    F.to_date("min_date").alias("min_date"), F.to_date("max_date").alias("max_date"))


def pick_date_column(summary: DataFrame, keys: Sequence[str] = ("client", "period"),
                     explicit: str | None = None) -> DataFrame:
    """Explicit wins; exactly one passing -> it; several -> 'ambiguous' (DATE_AMBIGUITY); none -> fewest blockers."""
    if explicit is not None:  # a column that a report lacks is said to be missing, not left out
        named = summary.where(F.col("column_name") == explicit).select(*keys, F.col("column_name").alias("_c"), "passed")
        return summary.select(*keys).distinct().join(named, list(keys), "left").select(
            *keys, F.col("_c").alias("date_column"),
            F.when(F.col("_c").isNull(), "explicit_not_found").otherwise("explicit").alias("status"),
            F.coalesce(F.col("passed").cast("int"), F.lit(0)).cast("long").alias("n_passing"))
    w = Window.partitionBy(*keys).orderBy(F.col("passed").desc(), "n_blockers", "cand_ord")
    ranked = summary.withColumn("_r", F.row_number().over(w)) \
        .withColumn("n_passing", F.count_if("passed").over(Window.partitionBy(*keys)))
    top = ranked.where("_r = 1")
    status = (F.when(F.col("n_passing") == 1, "single_pass").when(F.col("n_passing") > 1, "ambiguous")
              .otherwise("least_broken"))
    return top.select(*keys, F.when(F.col("n_passing") > 1, F.lit(None).cast("string"))
                      .otherwise(F.col("column_name")).alias("date_column"), status.alias("status"),
                      F.col("n_passing").cast("long").alias("n_passing"))
