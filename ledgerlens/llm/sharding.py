"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone; no table of ranges or ring is kept. When
shards are appended, a key stays or moves to one of the new shards, and only the share of keys moves that
the new shards have to hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Fixed values of the published algorithm (Lamping and Veach, 2014).
MULTIPLIER, INCREMENT, SHIFT, SCALE = 2862933555777941757, 1, 33, 2.0**31


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards (0 to ``shards`` - 1) of unsigned 64-bit keys."""
    state = keys.astype(np.uint64)
    shard, jump = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    left = np.arange(len(state))
    while len(left):
        shard[left] = jump[left]
        state[left] = state[left] * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
        jump[left] = ((shard[left] + 1) * (SCALE / ((state[left] >> np.uint64(SHIFT)).astype(np.float64) + 1))).astype(np.int64)
        left = left[jump[left] < shards]
    return shard


def shard_column(key: str | Column, shards: int) -> Column:
    """The shard of a key of any type; the key is hashed to 64 bits first. Null keys share one shard."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.arrow_udf("int")
    def of(hashes: pa.Array) -> pa.Array:
        return pa.array(jump_hash(hashes.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return of(F.xxhash64(key))


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row for each row of ``docs``: the key, ``size`` (UTF-8 bytes of the text, null as none, plus 1),
    ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (its shard if there was one more).

    ``slot`` numbers a shard's rows from 0 without gaps, by key (null keys first; repeated keys in any order).
    No shard is gathered in one task: rows are sorted over all tasks by ranges of (shard, key, row), and a task's
    rows start after those of the tasks before it. Other columns are not read; an empty table gives no rows.
    """
    text = text_or_empty(text_col)
    placed = materialise(docs.select(
        F.col(key_col).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_column(key_col, shards).alias("shard"), shard_column(key_col, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row")))
    order = ["shard", "key", "row"]
    ranged = materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    # a row for each task and shard in it: at most as many as there are tasks and shards together
    runs = ranged.groupBy("shard", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(F.broadcast(starts), ["shard", "task"]).select(
        F.col("key").alias(key_col), "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", shards: int = 8) -> None:
    """Write ``docs`` as a Parquet table with a folder for each shard (column ``shard``)."""
    docs.withColumn("shard", shard_column(key_col, shards)).write.partitionBy("shard").parquet(path)
