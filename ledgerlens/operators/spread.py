"""Spread CPU-heavy per-row work over the cluster.

A scan yields one task per file split, and a parquet row group cannot be split: a large single-row-group file is
read by one task, and everything fused into that stage (regex chains, rendering, parsing) runs single-threaded. ``spread``
hash-partitions the input on its row key into ``spark.sql.shuffle.partitions`` partitions. It does so always, at any size
and file layout, so that the plan that is tested is the plan that runs on a cluster; the work behind it costs several
times the exchange. Do not use it in front of a shuffle join or aggregate: those deal the rows out anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned on ``keys`` over the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
