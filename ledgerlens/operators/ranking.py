"""Exact rank within a group without sending a whole group to one task.

``rank() OVER (PARTITION BY g ORDER BY v DESC)`` puts every row of a group in
one task; with one client holding a third of all rows that task is the job.
Here the rank is ``1 + (rows of g with a larger v)``, computed as

1. distinct ``(g, v)`` with their multiplicity (a hot value collapses in the
   partial aggregate);
2. a global range sort on ``(g, v desc)`` — a large group spans many balanced
   partitions; the order is frozen with a reliable ``checkpoint()`` so a lost
   executor recomputes nothing inconsistent;
3. running count inside each (partition, group) piece, plus the count of the
   group's rows in earlier partitions (a table of at most
   partitions + groups rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import join_dim


def rank_desc(df: DataFrame, group: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Add ``out`` = SQL ``rank()`` of ``value`` (descending) within ``group``.

    Rows whose value is NULL get a NULL rank (the join key never matches).
    """
    g = list(group)
    ensure_checkpoint_dir(df.sparkSession)
    distinct = df.groupBy(*g, value).agg(F.count(F.lit(1)).alias("_cnt"))
    ordered = distinct.orderBy(*[F.col(c) for c in g], F.col(value).desc_nulls_last())
    ordered = ordered.withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_pid", F.shiftright("_mid", 33)).checkpoint(eager=True)
    local = Window.partitionBy("_pid", *g).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("_before", F.coalesce(F.sum("_cnt").over(local), F.lit(0)))
    pieces = ordered.groupBy("_pid", *g).agg(F.sum("_cnt").alias("_piece"))
    earlier = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_pid", *g, F.coalesce(F.sum("_piece").over(earlier), F.lit(0)).alias("_offset"))
    ranked = join_dim(ordered, pieces, ["_pid", *g]).select(
        *g, value, (F.col("_offset") + F.col("_before") + 1).cast("int").alias(out))
    return df.join(ranked, [*g, value], "left") if value in df.columns else ranked

