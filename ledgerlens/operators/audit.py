"""Append-only audit log and corrections log as tables; look-ups are window/aggregate jobs.

``audit`` has the 18 fields of a run record (see :data:`AUDIT_SCHEMA`). Logs are
written partitioned by (client_slug, year) and read with a fixed schema
(unknown fields dropped, missing ones NULL, malformed lines skipped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import client_slug, sha16
from ..session import ensure_checkpoint_dir
from .joins import broadcast_if_small

AUDIT_SCHEMA = (
    "report_id STRING, client_name STRING, period STRING, generated_at STRING, source_data_hash STRING, "
    "prompt_hash STRING, response_hash STRING, kpi_snapshot MAP<STRING, MAP<STRING, DOUBLE>>, "
    "gate_passed BOOLEAN, gate_flags ARRAY<STRUCT<severity: STRING, code: STRING, message: STRING>>, "
    "delivery STRING, cost_eur DOUBLE, model STRING, date_column_used STRING, schema_drift_clean BOOLEAN, "
    "volatility_thresholds MAP<STRING, DOUBLE>, late_correction BOOLEAN, supersedes STRING")
CORRECTION_SCHEMA = ("report_id STRING, logged_at STRING, logged_by STRING, field STRING, claimed_value DOUBLE, "
                     "actual_value DOUBLE, source_of_truth STRING, severity STRING, client_name STRING")
MATERIAL_SHARE = 0.02  # fixed: > 2 % of the field's magnitude is material


def report_id(client: Column, period: Column, source_hash: Column, late_correction: Column) -> Column:
    """16-hex id of (client, period, data hash, original/corrected)."""
    flag = F.when(late_correction, F.lit("corrected")).otherwise(F.lit("original"))
    return sha16(F.concat_ws("|", client, period, source_hash, flag))


def row_text(cols: list[tuple[str, Column]]) -> Column:
    """Names, null marks and values of a row as one text; no two different rows share it."""
    def part(name: str, c: Column) -> Column:
        v = c.cast("string")
        return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("null")), F.lit(";"))

    return F.concat(*[part(n, c) for n, c in cols])


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free content hash per key group: row hashes over name-sorted columns, combined by
    count, sum and xor (all associative, so partial aggregation and any partitioning agree).

    A row's hash covers the columns' names, which of them are null, and their values: moved nulls or a
    renamed column change it.
    """
    cols = sorted(c for c in df.columns if c not in keys)
    h = F.conv(F.substring(F.md5(row_text([(c, F.col(c)) for c in cols])), 1, 15), 16, 10).cast("long")
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_s"),
                                F.bit_xor(h).alias("_x"))
    digest = F.concat_ws("|", F.col("_n").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string"))
    return agg.select(*keys, sha16(digest).alias("source_data_hash"), F.col("_n").alias("row_count"))


def complete_record(audit: DataFrame, delta: DataFrame, threshold: DataFrame, costs: DataFrame, date_column: str,
                    static_fallback: float = 15.0) -> DataFrame:
    """``audit`` with the rest of the record's fields: KPI snapshot, thresholds, cost, model and date column of each report.

    Every map is built per report (its KPIs), from tables with a row for each report and KPI.
    """
    d = delta.join(threshold.select("client", "kpi", "threshold_pct"), ["client", "kpi"], "left")
    values = F.create_map(F.lit("current"), F.col("current"), F.lit("previous"), F.col("previous"), F.lit("abs"), F.col("abs"), F.lit("pct"), F.col("pct"))
    maps = d.groupBy(F.col("client").alias("client_name"), "period").agg(
        F.map_from_entries(F.collect_list(F.struct("kpi", values.alias("v")))).alias("kpi_snapshot"),
        F.map_from_entries(F.collect_list(F.struct("kpi", F.coalesce("threshold_pct", F.lit(static_fallback)).alias("t")))).alias("volatility_thresholds"))
    cost = costs.groupBy("client_name", "period").agg(F.round(F.sum("eur"), 6).alias("cost_eur"), F.max("model").alias("model"))
    known = [c for c in ("kpi_snapshot", "volatility_thresholds", "cost_eur", "model", "date_column_used") if c in audit.columns]
    return (audit.drop(*known).join(maps, ["client_name", "period"], "left").join(cost, ["client_name", "period"], "left")
            .withColumn("date_column_used", F.lit(date_column)))


def write_log(df: DataFrame, path: str, client_col: str = "client_name") -> None:
    """Append-only sink, one folder per client slug and year (the year of the period)."""
    (df.withColumn("client_slug", client_slug(F.col(client_col)))
     .withColumn("year", F.substring("period", 1, 4))
     .write.mode("append").partitionBy("client_slug", "year").json(path))


def read_log(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Fixed-schema read: malformed lines dropped, unknown fields ignored, missing fields NULL/defaulted."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if "late_correction" in df.columns:
        df = df.withColumn("late_correction", F.coalesce("late_correction", F.lit(False)))
    return df


def log_lines(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, key: str = "report_id") -> DataFrame:
    """lines(file, status, reason, value, record): every line of a log, once; none is dropped.

    ``status`` is ``read``; ``repeated`` for a line whose content was read before (re-delivered files; the line of the first file in name order
    is the one that counts); or ``rejected``, with a ``reason``: ``blank``, ``malformed`` (no JSON, or a value of another type), ``no_key`` (the field
    ``key`` is missing or null). ``record`` has the fields of ``schema``: unknown fields are ignored, missing ones are null.
    """
    ensure_checkpoint_dir(spark)
    corrupt = "_corrupt"
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("_line"))
    parsed = raw.withColumn("record", F.from_json("value", f"{schema}, {corrupt} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    blank = F.trim("value") == ""
    reason = F.when(blank, "blank").when(F.col("record").isNull() | F.col(f"record.{corrupt}").isNotNull(), "malformed").when(F.col(f"record.{key}").isNull(), "no_key")
    lines = parsed.withColumns({"reason": reason, "_content": F.sha2("value", 256), "record": F.col("record").dropFields(corrupt)}).checkpoint()
    place = F.struct("file", "_line")
    first = lines.where("reason IS NULL").groupBy("_content").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_content", "_first").checkpoint()
    j = lines.join(broadcast_if_small(first), "_content", "left")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_first") != place, "repeated").otherwise("read")
    return j.select("file", status.alias("status"), "reason", "value", F.when(F.col("reason").isNull(), F.col("record")).alias("record"))


def read_log_once(lines: DataFrame) -> DataFrame:
    """The records of :func:`log_lines` that count, each once, with the defaults of :func:`read_log`."""
    df = lines.where("status = 'read'").select("record.*")
    return df.withColumn("late_correction", F.coalesce("late_correction", F.lit(False))) if "late_correction" in df.columns else df


def _ordered(audit: DataFrame, asc: bool) -> Window:
    o = [F.col("generated_at"), F.col("seq")]
    return Window.partitionBy("client_name", "period").orderBy(*[c.asc() if asc else c.desc() for c in o])


def latest(audit: DataFrame) -> DataFrame:
    """Last written entry per (client, period) — may be a late correction."""
    return audit.withColumn("_r", F.row_number().over(_ordered(audit, False))).where("_r = 1").drop("_r")


def original(audit: DataFrame) -> DataFrame:
    """First entry per (client, period) that is not a late correction."""
    a = audit.where(~F.col("late_correction"))
    return a.withColumn("_r", F.row_number().over(_ordered(a, True))).where("_r = 1").drop("_r")


def history(audit: DataFrame, client: str) -> DataFrame:
    return audit.where(F.col("client_name") == client).orderBy("generated_at", "seq")


def supersedes_chain(spark: SparkSession, audit: DataFrame) -> DataFrame:
    """(report_id, root_id, depth, cyclic): the original that each report goes back to over ``supersedes`` links.

    Pointer doubling: each step joins every report to the report that its pointer names and takes over that one's pointer,
    so a chain of n links needs about log2(n) joins, whatever the data; each step is checkpointed. A link to a report that
    isn't in the log ends there (that id is the root). Reports that lead into a cycle never reach a root: when the steps
    exceed the number of reports they are what is left, and come out with ``cyclic``, no root and no depth.
    """
    links = audit.where("report_id is not null").groupBy("report_id").agg(F.max("supersedes").alias("to"))
    now = links.select("report_id", F.coalesce("to", "report_id").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                       F.col("to").isNull().alias("done")).checkpoint()
    n, reach = now.count(), 1
    while now.where("not done").limit(1).count() and reach <= n:
        step = now.select(F.col("report_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        now = (now.where("done").unionByName(now.where("not done").join(step, "at", "left").select(
            "report_id", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("ends", F.lit(True)).alias("done")))).checkpoint()
        reach *= 2
    return now.select("report_id", F.when(F.col("done"), F.col("at")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"), (~F.col("done")).alias("cyclic"))


def correction_severity(claimed: Column, actual: Column) -> Column:
    return F.when(F.abs(actual - claimed) > F.abs(claimed) * MATERIAL_SHARE, "material").otherwise("cosmetic")
