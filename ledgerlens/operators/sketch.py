"""Column fingerprints that can be merged: drift reads new data only.

A column's sketch is the k smallest of its values' hashes. It gives the number of distinct values (exactly, while there are fewer than
k; else estimated from the largest hash kept, with a relative error of about 1 / sqrt(k)), and a stable sample. The sketch of a
union is made of the sketches of its parts, and equals, bit for bit, that of all rows.

Two passes over new rows, and no row is unpivoted whole: one aggregate counts rows and nulls and estimates the distinct values of all columns; then
only hashes below a bound, about ``SPARE * k`` of each column's, leave the row. If a bound proves too low the column is sketched without one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import broadcast_if_small
from .profile import column_meta

#: Hashes kept, samples kept, and how many times as many hashes as kept are expected below the bound.
KEPT, SAMPLES, SPARE = 1024, 5, 4
_TOP = (1 << 63) - 1


def _hash(c: str) -> Column:
    """63 bits of a value's hash; null for null."""
    return F.when(F.col(c).isNotNull(), F.xxhash64(c).bitwiseAND(F.lit(_TOP)))


def sketch(df: DataFrame, table_name: str, group: str, kept: int = KEPT) -> DataFrame:
    """fingerprint(table_name, group, column_name, ord, dtype, is_numeric, is_datetime, row_count, null_count, hashes, samples).

    One row for each column and each value of ``group`` (null is a value). ``samples`` are (hash, text) of the first hashes. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols = [c for c in df.columns if c != group]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"_n{i}"), F.approx_count_distinct(_hash(c)).alias(f"_d{i}")]
    one = df.groupBy(group).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("_i"), (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"), F.col(f"_d{i}").alias("_d")) for i, c in enumerate(cols)])
    share = F.lit(float(SPARE * kept)) / F.greatest("_d", F.lit(1))
    counts = one.select(group, F.col("_rows").alias("row_count"), F.inline(rows)).withColumn("_bound", F.when(share >= 1, F.lit(_TOP)).otherwise((share * float(_TOP)).cast("long"))).checkpoint()
    found = _smallest(df, cols, group, counts, kept).checkpoint()
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_i") == F.col("_j"))
    low = counts.where(F.col("_bound") < _TOP).join(found, same, "left").where(F.coalesce(F.size("hashes"), F.lit(0)) < kept)
    if not low.isEmpty():  # an estimate was far too high: these columns again, without a bound
        more = _smallest(df, cols, group, low.select(group, "_i", F.lit(_TOP).alias("_bound")), kept).checkpoint()
        again = more.select(F.col("_g").alias("_g2"), F.col("_j").alias("_j2"))
        found = found.join(again, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_j") == F.col("_j2")), "left_anti").unionByName(more).checkpoint()
    meta = spark.createDataFrame(column_meta(df, table_name, group), "table_name STRING, column_name STRING, ord INT, dtype STRING, is_numeric BOOLEAN, is_datetime BOOLEAN")
    j = counts.join(found, same, "left")
    none = F.array()
    return j.join(broadcast_if_small(meta), "column_name").select(
        "table_name", group, "column_name", "ord", "dtype", "is_numeric", "is_datetime", "row_count", "null_count",
        F.coalesce("hashes", none.cast("array<bigint>")).alias("hashes"), F.coalesce("samples", none.cast("array<struct<h:bigint,v:string>>")).alias("samples"))


def _smallest(df: DataFrame, cols: Sequence[str], group: str, counts: DataFrame, kept: int) -> DataFrame:
    """(_g, _j, hashes, samples): the smallest hashes of each column that ``counts`` names, from those below its bound."""
    bounds = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_bound"))).alias("_bounds")).withColumnRenamed(group, "_g")
    j = df.join(broadcast_if_small(bounds.checkpoint()), F.col(group).eqNullSafe(F.col("_g")))
    h = [(i, _hash(c), F.try_element_at("_bounds", F.lit(i)), F.col(c).cast("string")) for i, c in enumerate(cols)]
    few = F.array(*[F.when(x <= bound, F.struct(F.lit(i).alias("_i"), x.alias("h"), v.alias("v"))) for i, x, bound, v in h])
    # the many rows meet in an aggregate without a text buffer, which hashes; one with a minimum of texts would sort all of a task's rows
    seen = j.select(group, F.inline(F.array_compact(few))).groupBy(group, "_i", "h", "v").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    low = seen.groupBy(group, "_i", "h").agg(F.min("v").alias("v"))
    w = Window.partitionBy(group, "_i").orderBy("h")
    least = low.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= kept)
    return least.groupBy(F.col(group).alias("_g"), F.col("_i").alias("_j")).agg(F.array_sort(F.collect_list("h")).alias("hashes"), F.array_sort(F.collect_list(F.when(F.col("_r") <= SAMPLES, F.struct("h", "v")))).alias("samples"))


def merge(parts: DataFrame, kept: int = KEPT) -> DataFrame:
    """Fingerprints of the same columns as one: counts are added, of all hashes the smallest are kept.

    Columns are the same if table, group, name and type are; a column that changed its type keeps a row for each.
    """
    keys = [c for c in parts.columns if c not in ("ord", "row_count", "null_count", "hashes", "samples")]
    together = lambda c, n: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, n)
    return parts.groupBy(*keys).agg(F.max("ord").alias("ord"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
                                    together("hashes", kept).alias("hashes"), together("samples", SAMPLES).alias("samples")).select(*parts.columns)


def cardinality(hashes: Column, kept: int = KEPT) -> Column:
    """Distinct values: their number while fewer than ``kept`` hashes are there, else an estimate."""
    return F.when(F.size(hashes) < kept, F.size(hashes).cast("long")).otherwise(F.round(F.lit(float(kept - 1)) * float(_TOP) / F.element_at(hashes, kept).cast("double")).cast("long"))


def as_profile(fingerprint: DataFrame, kept: int = KEPT) -> DataFrame:
    """What :func:`..profile.drift` compares: the columns of a profile without samples."""
    keys = [c for c in fingerprint.columns if c not in ("ord", "hashes", "samples")]
    return fingerprint.select(*keys, cardinality(F.col("hashes"), kept).alias("cardinality"), (F.col("null_count") / F.greatest("row_count", F.lit(1))).alias("null_rate"))
