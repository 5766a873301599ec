"""Keyed pseudonyms with a mapping table.

A pseudonym is the HMAC-SHA-256 of a name under the caller's key, cut to 128 bits: the same name has the same pseudonym in every run, and
nobody without the key can test a guess. The mapping table is append-only: a run adds the names that it doesn't hold yet, and it alone
leads back to names. The key is never stored; as any literal it stands in the query's plan, so plans of these jobs must not be shared.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING_SCHEMA = "name STRING, pseudonym STRING, first_run STRING"
BITS, BLOCK = 128, 64


def keyed_pseudonym(name: Column, key: bytes, prefix: str = "p_") -> Column:
    """``prefix`` and 32 hex digits; null for null. The key has 16 bytes at least."""
    if len(key) < 16:
        raise ValueError("the key has 16 bytes at least")
    if len(key) > BLOCK:
        raise ValueError(f"the key has {BLOCK} bytes at most")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key.ljust(BLOCK, b"\0"))) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, name.cast("binary")), 256))), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, BITS // 4))


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The mapping; no rows where none was written yet."""
    try:
        return spark.read.schema(MAPPING_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MAPPING_SCHEMA)


def new_entries(names: DataFrame, mapping: DataFrame, key: bytes, run: str, name_col: str = "name") -> DataFrame:
    """The mapping rows of names that ``mapping`` doesn't hold. Repeated names give one row, null names none."""
    fresh = names.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().join(mapping.select("name"), "name", "left_anti")
    return fresh.select("name", keyed_pseudonym(F.col("name"), key).alias("pseudonym"), F.lit(run).alias("first_run"))


def append_mapping(names: DataFrame, path: str, key: bytes, run: str, name_col: str = "name") -> DataFrame:
    """Add what is new to the mapping at ``path`` and return the whole mapping."""
    spark = names.sparkSession
    new_entries(names, load_mapping(spark, path), key, run, name_col).write.mode("append").parquet(path)
    return load_mapping(spark, path)


def collisions(mapping: DataFrame) -> DataFrame:
    """Pseudonyms of more than one name, and names of more than one pseudonym (another key): (kind, value, held). None is expected."""
    return (mapping.groupBy(F.lit("pseudonym").alias("kind"), F.col("pseudonym").alias("value")).agg(F.count_distinct("name").alias("held"))
            .unionByName(mapping.groupBy(F.lit("name").alias("kind"), F.col("name").alias("value")).agg(F.count_distinct("pseudonym").alias("held"))).where("held > 1"))


def restore(df: DataFrame, mapping: DataFrame, col: str, out: str = "name") -> DataFrame:
    """``df`` with the names behind its pseudonyms; null where the mapping has none."""
    return df.join(mapping.select(F.col("pseudonym").alias(col), F.col("name").alias(out)), col, "left")
