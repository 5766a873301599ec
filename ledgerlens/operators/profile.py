"""Column profiles, role rules, star-schema detection and schema drift.

The profile of many tables is one job: each column alone is read and grouped by
its typed values (a map-side partial aggregate; no row is unpivoted), only
distinct values become text, and per column we keep the distinct count, null
count, row count and the 5 smallest texts (each task keeps 5, so no column's
values are ever collected whole).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import broadcast_if_small

# Fixed values (parity with the reference).
ID_PATTERN = r"(?i)(^id$|_id$|^code$|_code$|_no$|^no_|_key$|^key_)"
IGNORE_PATTERN = r"(?i)(unnamed|empty|blank|filler)"
MAX_DIM_CARDINALITY_RATIO = 0.05
MAX_INLINE_DIM_CARDINALITY = 200
CARDINALITY_EXPLOSION_RATIO = 5
SAMPLE_SIZE = 5

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
            T.BooleanType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column_meta(df: DataFrame, table_name: str, key: str | None = None) -> list[tuple]:
    """Schema facts (driver-side metadata, one tuple per column): ord, dtype, is_numeric, is_datetime."""
    out = []
    for i, f in enumerate(df.schema.fields):
        if key is not None and f.name == key:
            continue
        out.append((table_name, f.name, i, f.dataType.simpleString(),
                    isinstance(f.dataType, _NUMERIC), isinstance(f.dataType, _DATETIME)))
    return out


def approximate_counts(df: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Rows, nulls and estimated distinct values of every column in one aggregate: nothing is unpivoted, no value is shuffled."""
    cols = [c for c in df.columns if c != group]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"_n{i}"), F.approx_count_distinct(c).alias(f"_d{i}")]
    one = df.groupBy(*([group] if group else [])).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("row_count"), F.col(f"_d{i}").alias("cardinality"),
                              (F.col("_rows") - F.col(f"_n{i}")).alias("null_count")) for i, c in enumerate(cols)])
    return one.select(F.lit(name).alias("table_name"), *([group] if group else []), F.inline(rows))


def distinct_values(df: DataFrame, c: str, group: str | None = None) -> DataFrame:
    """([group,] value, _n): how often each value of a column, as text, is there (null is a value).

    Rows meet by the value itself where equal values have equal texts and the other way round; zero and minus zero, which group alike, keep their texts apart.
    """
    by, kind, keys = F.col(c), df.schema[c].dataType, [group] if group else []
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        zero = F.when(by == 0, by.cast("string"))
        found = df.groupBy(*keys, by.alias("_v"), zero.alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
        return found.select(*keys, F.coalesce("_z", F.col("_v").cast("string")).alias("value"), "_n")
    own = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType))
    found = df.groupBy(*keys, (by if own else by.cast("string")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return found.select(*keys, F.col("_v").cast("string").alias("value"), "_n")


def profile(tables: dict[str, DataFrame], group: str | None = None, samples: bool = True, approximate: bool = False) -> DataFrame:
    """column_profile(table_name[, group], column, ord, dtype, is_numeric, is_datetime,
    row_count, cardinality, null_count, null_rate, samples).

    ``group`` (e.g. client) profiles each group of a table separately in the same job.
    ``samples=False`` leaves out the samples column and its window (a drift
    fingerprint needs only types and counts). ``approximate=True`` is the caller's choice for large tables: distinct
    counts are estimates, from one aggregate without an unpivot (no samples then).
    """
    spark = next(iter(tables.values())).sparkSession
    longs, meta, samples = None, [], samples and not approximate
    for name, df in tables.items():
        meta += column_meta(df, name, group)
        if approximate:
            part = approximate_counts(df, name, group)
            longs = part if longs is None else longs.unionByName(part)
            continue
        for c in [c for c in df.columns if c != group]:
            part = distinct_values(df, c, group).select(F.lit(name).alias("table_name"), *([group] if group else []), F.lit(c).alias("column_name"), "value", "_n")
            longs = part if longs is None else longs.unionByName(part)
    g = ["table_name"] + ([group] if group else [])
    per_col = longs if approximate else longs.groupBy(*g, "column_name").agg(
        F.sum("_n").alias("row_count"), F.count("value").alias("cardinality"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"))
    meta_df = spark.createDataFrame(meta, "table_name STRING, column_name STRING, ord INT, dtype STRING, "
                                          "is_numeric BOOLEAN, is_datetime BOOLEAN")
    prof = per_col
    if samples:
        # the counts are read and nulls leave only after the window, so that both branches share one shuffle of the distinct values
        w = Window.partitionBy(*g, "column_name").orderBy(F.col("value").asc_nulls_last())
        smp = (longs.where(F.col("_n") > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SAMPLE_SIZE).where(F.col("value").isNotNull())
               .groupBy(*g, "column_name").agg(F.array_sort(F.collect_list("value")).alias("samples")))
        prof = prof.join(smp, [*g, "column_name"], "left")
    if group:
        prof = prof.join(broadcast_if_small(meta_df), ["table_name", "column_name"])
    else:  # an empty table has columns too, with no row: it is not a table whose columns are missing
        prof = meta_df.join(prof, ["table_name", "column_name"], "left").na.fill(0, ["row_count", "cardinality", "null_count"])
    return prof.select(*g, "column_name", "ord", "dtype", "is_numeric", "is_datetime",
                       F.col("row_count").cast("long").alias("row_count"),
                       F.col("cardinality").cast("long").alias("cardinality"),
                       F.col("null_count").cast("long").alias("null_count"),
                       F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(F.lit(0.0)).alias("null_rate"),
                       *([F.coalesce(F.array_join("samples", "|"), F.lit("")).alias("samples")] if samples else []))


def roles(prof: DataFrame) -> DataFrame:
    """Role rules in order: ignore, date, id_key, numeric measure / numeric_cat dimension, text dimension."""
    ratio = F.col("cardinality") / F.greatest(F.col("row_count"), F.lit(1))
    role = (F.when(F.col("column_name").rlike(IGNORE_PATTERN), "ignore")
            .when(F.col("is_datetime"), "date")
            .when(F.col("column_name").rlike(ID_PATTERN), "id_key")
            .when(F.col("is_numeric") & (ratio > MAX_DIM_CARDINALITY_RATIO), "numeric_measure")
            .otherwise("text_dimension"))
    kind = (F.when(F.col("column_name").rlike(IGNORE_PATTERN), F.col("dtype"))
            .when(F.col("is_datetime"), "datetime")
            .when(F.col("column_name").rlike(ID_PATTERN), F.col("dtype"))
            .when(F.col("is_numeric") & (ratio > MAX_DIM_CARDINALITY_RATIO), "numeric")
            .when(F.col("is_numeric"), "numeric_cat").otherwise("text"))
    return prof.withColumn("role", role).withColumn("role_dtype", kind)


def fact_selection(prof: DataFrame, order: Sequence[str]) -> DataFrame:
    """The table with most rows is the fact (first in ``order`` on a tie)."""
    spark = prof.sparkSession
    ords = spark.createDataFrame(list(enumerate(order)), "table_ord INT, table_name STRING")
    sizes = prof.groupBy("table_name").agg(F.max("row_count").alias("row_count")).join(broadcast_if_small(ords), "table_name")
    best = sizes.agg(F.max(F.struct("row_count", (-F.col("table_ord")).alias("o"), "table_name")).alias("_b"))
    return sizes.withColumn("is_fact", F.col("table_name") == best.select("_b.table_name").scalar())


def dim_keys(prof: DataFrame, fact_table: DataFrame) -> DataFrame:
    """Key of each non-fact table with >= 2 rows: first id-like or fully unique column, else the first."""
    cand = prof.join(fact_table.where(~F.col("is_fact")).select("table_name"), "table_name", "left_semi") \
        .where(F.col("row_count") >= 2)
    good = F.col("column_name").rlike(ID_PATTERN) | (F.col("cardinality") == F.col("row_count"))
    w = Window.partitionBy("table_name").orderBy(F.when(good, 0).otherwise(1), "ord")
    return (cand.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("table_name", F.col("column_name").alias("key_column"), good.alias("key_is_id_or_unique")))


def inline_dim_columns(roles_df: DataFrame, fact_name: str) -> DataFrame:
    """Fact dimension columns with at most 200 distinct values become ``dim_<col>`` tables."""
    return (roles_df.where((F.col("table_name") == fact_name) & (F.col("role") == "text_dimension")
                           & (F.col("cardinality") <= MAX_INLINE_DIM_CARDINALITY))
            .select("column_name", F.concat(F.lit("dim_"), "column_name").alias("dim_name"), "cardinality"))


def inline_dim_values(fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dim_name, key_value): distinct non-null values of each inline dimension, one job for all."""
    pairs = F.array(*[F.struct(F.lit(f"dim_{c}").alias("dim_name"), F.col(c).cast("string").alias("key_value"))
                      for c in columns])
    return fact.select(F.inline(pairs)).where(F.col("key_value").isNotNull()).distinct()


def relationships(fact_name: str, fact_columns: Sequence[str], dims: DataFrame) -> DataFrame:
    """Many-to-one relationships: a dim's key column name exists in the fact (``dims``: dim_name, key_column)."""
    return (dims.where(F.col("key_column").isin(list(fact_columns)))
            .select(F.lit(fact_name).alias("from_table"), F.col("key_column").alias("from_column"),
                    F.col("dim_name").alias("to_table"), F.col("key_column").alias("to_column"),
                    F.lit("many_to_one").alias("cardinality")))


def orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str, name: str) -> DataFrame:
    """Fact keys with no dimension row (the check that makes a many-to-one join safe)."""
    keys = fact.select(F.col(fk).alias("_k")).where(F.col("_k").isNotNull())
    miss = keys.join(dim.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("orphan_rows"), F.countDistinct("_k").alias("orphan_keys")) \
        .select(F.lit(name).alias("relationship"), "orphan_rows", "orphan_keys")


def model_summary(roles_df: DataFrame, fact_name: str) -> DataFrame:
    r = roles_df.where(F.col("table_name") == fact_name)
    pick = lambda role: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("column_name")))), ",")
    return r.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), pick("numeric_measure").alias("measures"),
        pick("date").alias("dates"), pick("text_dimension").alias("dimensions"))


# ---------------------------------------------------------------- drift

def drift(previous: DataFrame, current: DataFrame, key: Sequence[str] = ("table_name",)) -> DataFrame:
    """Compare two fingerprints on (key, column) with a full outer join.

    COLUMN_MISSING (block), COLUMN_ADDED (warn), TYPE_REGRESSION (numeric -> not, block),
    else DATE_REGRESSION (datetime -> not, block); CARDINALITY_EXPLOSION (warn) when
    the column is non-numeric now, the old count > 0 and the ratio > 5.
    """
    k = list(key)
    p = previous.select(*k, "column_name", *[F.col(c).alias(f"p_{c}") for c in ("dtype", "cardinality", "is_numeric", "is_datetime")])
    c = current.select(*k, "column_name", *[F.col(x).alias(f"c_{x}") for x in ("dtype", "cardinality", "is_numeric", "is_datetime")])
    j = p.join(c, [*k, "column_name"], "full_outer")
    ratio = F.col("c_cardinality") / F.col("p_cardinality")
    def ev(code, sev, metric=None):
        m = F.lit(None).cast("double") if metric is None else metric.cast("double")
        return F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), m.alias("metric"))

    both = F.col("p_dtype").isNotNull() & F.col("c_dtype").isNotNull()
    events = F.array(
        F.when(F.col("c_dtype").isNull(), ev("COLUMN_MISSING", "block")),
        F.when(F.col("p_dtype").isNull(), ev("COLUMN_ADDED", "warn")),
        F.when(both & F.col("p_is_numeric") & ~F.col("c_is_numeric"), ev("TYPE_REGRESSION", "block"))
         .when(both & F.col("p_is_datetime") & ~F.col("c_is_datetime"), ev("DATE_REGRESSION", "block")),
        F.when(both & ~F.col("c_is_numeric") & (F.col("p_cardinality") > 0) & (ratio > CARDINALITY_EXPLOSION_RATIO),
               ev("CARDINALITY_EXPLOSION", "warn", ratio)))
    out = j.select(*k, "column_name", F.inline(F.filter(events, lambda e: e.isNotNull())))
    return out.select(*k, "column_name", "code", "severity", "metric")


def drift_report(events: DataFrame, tables: DataFrame, key: Sequence[str] = ("table_name",)) -> DataFrame:
    """Per table of ``tables``: whether any event blocks, how many events there are, and whether there is none."""
    k = list(key)
    n = events.groupBy(*k).agg(F.bool_or(F.col("severity") == "block").alias("has_blockers"), F.count(F.lit(1)).alias("events"))
    j = tables.select(*k).distinct().join(n, k, "left")
    return j.select(*k, F.coalesce("has_blockers", F.lit(False)).alias("has_blockers"), F.coalesce("events", F.lit(0)).cast("long").alias("events"),
                    (F.coalesce("events", F.lit(0)) == 0).alias("is_clean"))


# ---------------------------------------------------------------- dataset schema export

# BI column types. Spark types map exactly; role types follow the reference's ordered
# substring rule (so ``numeric_cat`` reads as Double, as there).
BI_EXACT = {"bigint": "Int64", "int": "Int64", "smallint": "Int64", "tinyint": "Int64", "double": "Double",
            "float": "Double", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "DateTime",
            "string": "String", "boolean": "Boolean"}
BI_BY_SUBSTRING = [("numeric", "Double"), ("datetime", "DateTime"), ("text", "String")]


def bi_type(dtype):
    e = None
    for k, v in BI_EXACT.items():
        e = F.when(dtype == k, F.lit(v)) if e is None else e.when(dtype == k, F.lit(v))
    for k, v in BI_BY_SUBSTRING:
        e = e.when(dtype.contains(k), F.lit(v))
    return e.otherwise(F.lit("String"))


def dataset_schema(roles_df: DataFrame, fact_name: str, keys: DataFrame) -> DataFrame:
    """(table_name, column_name, data_type): fact columns by type, dimension tables and inline dims as text."""
    fact = roles_df.where((F.col("table_name") == fact_name) & (F.col("role") != "ignore")).select(
        "table_name", "column_name", bi_type(F.col("role_dtype")).alias("data_type"))
    dims = roles_df.join(keys.select("table_name"), "table_name", "left_semi").select(
        "table_name", "column_name", F.lit("String").alias("data_type"))
    inline = inline_dim_columns(roles_df, fact_name).select(
        F.col("dim_name").alias("table_name"), "column_name", F.lit("String").alias("data_type"))
    return fact.unionByName(dims).unionByName(inline)
