"""Sinks: append-only logs, keyed upserts, push-row batches, held-report packets, fingerprints.

All writes go through Spark's commit protocol (task output is atomic per
file; a lost executor's partial files are never committed). Upserts never
read and overwrite the same path in one job: the merged result goes to a new
folder (or a dynamic partition overwrite of other partitions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import broadcast_if_small
from ..operators.volatility import latest_per_key
from ..session import ensure_checkpoint_dir

PUSH_BATCH_ROWS = 10_000  # fixed: rows per push batch
PUSH_HOUR_ROWS = 200_000  # fixed: rows that a push target takes in an hour


def push_rows(df: DataFrame) -> DataFrame:
    """Row dicts for a push API: timestamps as ``yyyy-MM-ddTHH:mm:ss`` text, NULLs kept."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_push_batches(df: DataFrame, path: str, batch_rows: int = PUSH_BATCH_ROWS) -> None:
    """JSON files of at most ``batch_rows`` rows each (one file = one push call)."""
    (push_rows(df).write.mode("overwrite").option("maxRecordsPerFile", batch_rows)
     .option("ignoreNullFields", "false").json(path))


def numbered_rows(df: DataFrame, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... without a gap, in the order of ``order`` over the whole table, which no single task sorts.

    Rows are range-sorted over all tasks; a row's number is its place in its task's range and the rows of the ranges before it (one count a
    range). Rows that ``order`` leaves equal are told apart by all their columns, so that numbers depend neither on the number of partitions nor on a re-run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.orderBy(*order, F.xxhash64(*df.columns)).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33)).checkpoint()
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = ranged.join(broadcast_if_small(offsets.checkpoint()), "_range")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(out))


def push_plan(df: DataFrame, order: Sequence[str], batch_rows: int = PUSH_BATCH_ROWS, hour_rows: int = PUSH_HOUR_ROWS) -> DataFrame:
    """The rows as :func:`push_rows` gives them, with ``batch`` (exactly ``batch_rows`` rows each, but for the last), ``hour`` (the hour slot that the
    batch goes in, so that no slot has more than ``hour_rows``) and ``place`` in the batch. Columns of these names are replaced."""
    rows = numbered_rows(df.drop("batch", "hour", "place"), order, "_ordinal")
    batch = F.floor(F.col("_ordinal") / batch_rows).cast("long")
    made = rows.withColumns({"batch": batch, "hour": F.floor(batch / max(1, hour_rows // batch_rows)).cast("long"), "place": (F.col("_ordinal") % batch_rows).cast("int")})
    return push_rows(made.drop("_ordinal"))


def write_push_plan(plan: DataFrame, path: str) -> None:
    """One JSON file for each batch, in a folder for each hour slot; rows in order of their place. A batch is bounded, and one task's."""
    (plan.repartition("hour", "batch").sortWithinPartitions("hour", "batch", "place").write.mode("overwrite")
     .option("ignoreNullFields", "false").partitionBy("hour", "batch").json(path))


def write_partitioned_json(df: DataFrame, path: str, by: Sequence[str], mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*by).json(path)


def keyed_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Replace the record of the same key, else append (latest ``order_col`` wins)."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    return latest_per_key(both, keys, [F.col(order_col).desc()])


def replace_records(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace whole records: every existing row of a key that comes in goes, whatever rows the new record has."""
    kept = existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def load_fingerprint(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored fingerprint; no rows where none was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_runs(current: DataFrame, stored: DataFrame, key: str = "client") -> DataFrame:
    """The current fingerprint of every key that has none stored: it is accepted as it is, and to be written."""
    return current.join(stored.select(key).distinct(), key, "left_anti")


def write_fingerprint(profile: DataFrame, path: str) -> None:
    """Schema fingerprint store: one partition per client, overwritten on approval."""
    (profile.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("client").parquet(path))
