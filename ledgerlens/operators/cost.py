"""Cost of text-generation calls per report: token prices, monthly totals by step, cache savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# USD per million tokens (input, output, cache write, cache read) and the EUR rate.
PRICE_INPUT = 3.00
PRICE_OUTPUT = 15.00
PRICE_CACHE_WRITE = 3.75
PRICE_CACHE_READ = 0.30
EUR_USD = 1.08


def usd(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column) -> Column:
    return (input_tokens * PRICE_INPUT / 1_000_000 + output_tokens * PRICE_OUTPUT / 1_000_000
            + cache_write * PRICE_CACHE_WRITE / 1_000_000 + cache_read * PRICE_CACHE_READ / 1_000_000)


def priced(calls: DataFrame) -> DataFrame:
    """Add usd and eur (eur = usd / rate) to calls(client_name, period, step, model, *_tokens)."""
    u = usd(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_write_tokens"), F.col("cache_read_tokens"))
    return calls.withColumn("usd", u).withColumn("eur", u / EUR_USD)


def by_step(costs: DataFrame) -> DataFrame:
    """Month total and per-step totals per client; the total row has step 'TOTAL'.

    Calls without a step, client or period are groups of their own (NULL), told from the total by ``grouping``.
    """
    by = [F.col(c) for c in ("client_name", "period", "step")]
    r = costs.groupingSets([by[:2], by], *by).agg(
        F.grouping("step").alias("_total"), F.sum("usd").alias("usd"), F.sum("eur").alias("eur"), F.count(F.lit(1)).alias("calls"))
    return r.select("client_name", "period", F.when(F.col("_total") == 1, F.lit("TOTAL")).otherwise(F.col("step")).alias("step"), "usd", "eur",
                    F.col("calls").cast("long").alias("calls"))


def cache_saving(costs: DataFrame) -> DataFrame:
    """Saving of cache reads vs full input price (eur = usd / rate)."""
    s = F.col("cache_read_tokens") * (PRICE_INPUT - PRICE_CACHE_READ) / 1_000_000
    return costs.select("client_name", "period", "step", s.alias("saving_usd"), (s / EUR_USD).alias("saving_eur"))


def session_total(costs: DataFrame) -> DataFrame:
    """Total usd and eur over the given calls (eur = usd / rate)."""
    return costs.agg(F.sum("usd").alias("usd"), (F.sum("usd") / EUR_USD).alias("eur"))


def monthly_summary(costs: DataFrame, as_of_month: str, client: str | None = None) -> DataFrame:
    """One month's cost by step plus the total row; ``as_of_month`` is a parameter, never the clock."""
    c = costs.where(F.col("period") == as_of_month)
    if client is not None:
        c = c.where(F.col("client_name") == client)
    return by_step(c)
