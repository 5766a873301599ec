"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sides below this estimate are shipped to every executor; anything larger is
# left to the planner (sort-merge / shuffled hash, AQE may still convert at
# runtime from real shuffle statistics). The limit is the engine's own default:
# estimates are compressed file bytes, and a built side may be several times larger.
BROADCAST_LIMIT_BYTES = 10 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of ``df`` (scan sizes after pruning and filters); very large where the session gives none."""
    if not hasattr(df, "_jdf"):  # pragma: no cover - Spark Connect
        return 1 << 62
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate proves the side is small."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def repeated_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): dimension keys that more than one row has. A many-to-one join on them would multiply facts."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def unique_dim(dim: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``: what a many-to-one join may meet. See :func:`repeated_keys` for the rest."""
    others = [c for c in dim.columns if c not in keys]
    rest = F.struct(*order, *[c for c in others if c not in order])
    return dim.groupBy(*keys).agg(F.min(rest).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
             limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Many-to-one join of a fact to a dimension; broadcast the dimension if it is small."""
    return fact.join(broadcast_if_small(dim, limit), on, how)
