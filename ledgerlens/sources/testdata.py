"""Readers for the driver's parquet tables and the sales fact built from them.

Mapping (see README): ``client := c_mktsegment``, ``period := yyyy-MM of
o_orderdate``. Money is carried as DECIMAL so sums are exact and independent
of the order of addition (two engines agree to the last digit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_dim

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Measures of the sales fact, in KPI order (fixed: the first one drives breakdowns).
MEASURES = ("revenue", "quantity", "discount")
MONEY = "DECIMAL(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_fact(spark: SparkSession, sf_dir: str, dims: bool = True) -> DataFrame:
    """One row per lineitem: client, period, dates, measures and dimensions.

    Join order is chosen for scale: orders ⋈ customer first (an orders-sized
    shuffle on custkey), then lineitem ⋈ that on orderkey, so the largest
    table is shuffled exactly once and the line-level rows never move again
    before the (map-side partial) aggregates. lineitem ⋈ orders is declared a
    sort-merge join: both sides grow with the data, so neither can be proven
    small, and a size estimate under the broadcast threshold (a small test
    file) would otherwise ship all line items to one build task. nation/region are fixed-size
    code tables behind the size-checked broadcast; ``dims=False`` skips them
    for jobs that need no geography.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    if dims:
        n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
        oc = join_dim(oc, geo, F.col("c_nationkey") == F.col("n_nationkey"))
    f = li.join(oc.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice").cast(MONEY)
    disc = F.col("l_discount").cast(MONEY)
    cols = [
        F.col("c_mktsegment").alias("client"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("o_orderdate"), F.col("l_shipdate"),
        (price * (F.lit(1) - disc)).alias("revenue"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        (price * disc).alias("discount"),
        F.col("l_orderkey"), F.col("o_custkey"), F.col("l_suppkey"), F.col("l_partkey"),
        F.col("c_name"), F.col("l_returnflag"),
    ]
    if dims:
        cols += [F.col("n_name"), F.col("r_name")]
    return f.select(*cols)


# DuckDB text of the same fact, for oracle SQL.
FACT_SQL = """
  SELECT c.c_mktsegment AS client, strftime(o.o_orderdate, '%Y-%m') AS period,
         o.o_orderdate, l.l_shipdate,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))) AS revenue,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(18,2)) AS discount,
         l.l_orderkey, o.o_custkey, l.l_suppkey, l.l_partkey, c.c_name, l.l_returnflag,
         n.n_name, r.r_name
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
"""


# Column types of the driver's tables as Spark reads them (used to write oracle SQL text).
SCHEMAS = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "region": [("r_regionkey", "int"), ("r_name", "string")],
}
STAR_TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region")
