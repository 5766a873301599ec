"""KPI synonym tables and the context-leak join.

``synonym(client, token, alt)``: the defaults below, overridden token by token
by a client's own rows. A KPI owns the words of its id longer than three
letters that are not neutral, plus their synonyms. A finding's context leaks
when one of its words is owned by another KPI of the same report and not by
the finding's own KPI.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import broadcast_if_small

# Default synonym table (canonical -> alternatives) and neutral words.
DEFAULT_SYNONYMS = {
    "revenue": ["sales", "turnover", "income", "topline", "bookings"],
    "sales": ["revenue", "turnover", "income", "topline", "bookings"],
    "cost": ["cogs", "expense", "spend", "outlay"],
    "cogs": ["cost", "expense", "spend"],
    "qty": ["units", "volume", "count", "quantity"],
    "quantity": ["qty", "units", "volume", "count"],
    "volume": ["qty", "units", "quantity"],
    "units": ["qty", "volume", "quantity", "count"],
    "margin": ["profit", "gross", "contribution"],
    "profit": ["margin", "earnings", "bottomline"],
    "discount": ["rebate", "markdown", "concession"],
    "price": ["rate", "tariff", "asp"],
    "customer": ["client", "buyer", "account"],
    "supplier": ["vendor", "partner"],
    "order": ["booking", "po"],
    "shipment": ["delivery", "dispatch"],
    "region": ["territory", "area", "geography"],
    "product": ["sku", "item", "article"],
}
NEUTRAL_TOKENS = ["total", "month", "period", "year", "data", "value", "number",
                  "change", "increase", "decrease", "growth", "drop"]

WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def default_synonyms(spark: SparkSession) -> DataFrame:
    rows = [(t, a) for t, alts in DEFAULT_SYNONYMS.items() for a in alts]
    return spark.createDataFrame(rows, "token STRING, alt STRING")


def resolve_synonyms(words: DataFrame, defaults: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Alternatives of each (client, tok): the client's own rows for a token replace the defaults."""
    d = broadcast_if_small(defaults.select(F.col("token").alias("tok"), "alt"))
    if overrides is None:
        return words.join(d, "tok").select("client", "kpi", F.col("alt").alias("tok"))
    ov = overrides.select("client", F.lower("token").alias("tok"), F.lower("alt").alias("alt"))
    own = words.join(ov, ["client", "tok"])
    dflt = words.join(ov.select("client", "tok").distinct(), ["client", "tok"], "left_anti").join(d, "tok")
    return own.unionByName(dflt, allowMissingColumns=True).select("client", "kpi", F.col("alt").alias("tok"))


def owned_tokens(kpis: DataFrame, defaults: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """owned(client, kpi, tok) over distinct (client, KPI name): small, one row per name and word."""
    words = (kpis.select("client", "kpi").distinct()
             .select("client", "kpi", F.explode(F.split(F.lower(F.regexp_replace("kpi", "_", " ")), " ")).alias("tok"))
             .where((F.length("tok") > 3) & ~F.col("tok").isin(NEUTRAL_TOKENS)))
    return words.unionByName(resolve_synonyms(words, defaults, overrides)).distinct()


def context_tokens(findings: DataFrame) -> DataFrame:
    """Distinct words of each finding's context (lower case)."""
    return (findings.select("client", "period", "idx", "kpi_id",
                            F.explode(F.split(F.lower("context"), WORD_SPLIT)).alias("tok"))
            .where(F.length("tok") > 0).distinct())


def leaks(findings: DataFrame, report_kpis: DataFrame, defaults: DataFrame,
          overrides: DataFrame | None = None) -> DataFrame:
    """leak(client, period, idx, kpi_id, leaked) — sorted comma list of leaked words.

    Everything joins on (client, period[, tok]), so the work per report is
    bounded by its own findings and KPIs.
    """
    owned = owned_tokens(report_kpis, defaults, overrides)
    report_owned = report_kpis.select("client", "period", "kpi").join(owned, ["client", "kpi"])
    toks = context_tokens(findings)
    hit = (toks.join(report_owned, ["client", "period", "tok"])
           .where(F.col("kpi") != F.col("kpi_id")).select("client", "period", "idx", "kpi_id", "tok"))
    # alternatives of several words are looked for whole; they are joined to the findings of their report only
    phrases = report_owned.where(F.col("tok").rlike(r"[^\p{L}\p{N}_]"))
    text = findings.select("client", "period", "idx", "kpi_id", F.concat(F.lit(" "), F.lower("context"), F.lit(" ")).alias("_text"))
    whole = F.regexp_like("_text", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("tok"), F.lit(r"\E(?!\w)")))
    hit = hit.unionByName(text.join(phrases, ["client", "period"]).where((F.col("kpi") != F.col("kpi_id")) & whole)
                          .select("client", "period", "idx", "kpi_id", "tok"))
    own = owned.select("client", F.col("kpi").alias("kpi_id"), "tok")
    hit = hit.join(own, ["client", "kpi_id", "tok"], "left_anti")
    return (hit.select("client", "period", "idx", "kpi_id", "tok").distinct()
            .groupBy("client", "period", "idx", "kpi_id")
            .agg(F.array_join(F.array_sort(F.collect_list("tok")), ",").alias("leaked")))
