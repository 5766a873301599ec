"""Commentary table derived from the KPI deltas (input of the review gate).

The test data has no commentary, so we derive one per (client, period) by
arithmetic on the month number and the client name, the way the rule-based
fallback writes findings, with known faults planted on fixed residues
(inflated magnitude, flipped direction, unknown or empty KPI id, leaking
context, inflated headline number, fallback marker, missing citations). The
same arithmetic is repeated in the oracle SQL (``COMMENTARY_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import direction_from_pct

# Fixed phrases planted in contexts: own-vocabulary vs another KPI's vocabulary.
CONTEXT_OWN = {"revenue": "sales picked up", "quantity": "volume held", "discount": "rebate programme"}
CONTEXT_LEAK = {"revenue": "units shipped", "quantity": "turnover slipped", "discount": "sales dipped"}


def seed_col() -> F.Column:
    return (F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")
            + F.length("client"))


def _measure_case(mapping: dict[str, str]) -> F.Column:
    e = None
    for m, text in mapping.items():
        cond = F.col("kpi").endswith("_" + m)
        e = F.when(cond, F.lit(text)) if e is None else e.when(cond, F.lit(text))
    return e.otherwise(F.lit("the market moved"))


def _amount(v: F.Column) -> F.Column:
    return F.format_number(F.floor(v), 0)


def derive_commentary(delta: DataFrame) -> DataFrame:
    """commentary(client, period, headline, executive_summary, key_findings, rca, ...)."""
    d = delta.withColumn("_seed", seed_col())
    k = F.col("_seed") + F.col("kpi_ord")
    base_dir = direction_from_pct(F.col("pct"))
    flipped = F.when(base_dir == "up", "down").when(base_dir == "down", "up").otherwise("up")
    finding = F.struct(
        F.col("kpi_ord").alias("ord"),
        F.when(k % 17 == 0, F.lit("")).when(k % 13 == 0, F.concat("kpi", F.lit("_ytd")))
         .otherwise(F.col("kpi")).alias("kpi_id"),
        F.when(k % 11 == 0, flipped).otherwise(base_dir).alias("direction"),
        (F.abs("pct") + F.when(k % 7 == 0, F.lit(7.5)).otherwise(F.lit(0.0))).alias("magnitude_pct"),
        F.when(k % 5 == 0, _measure_case(CONTEXT_LEAK)).otherwise(_measure_case(CONTEXT_OWN)).alias("context"))
    rev = F.col("kpi") == "total_revenue"
    per = d.groupBy("client", "period", "_seed").agg(
        F.collect_list(F.when(F.col("kpi_ord") <= 5, finding)).alias("_f"),
        F.max(F.when(rev, F.col("pct"))).alias("_pct"),
        F.max(F.when(rev, F.col("current"))).alias("_cur"),
        F.max(F.when(rev, F.col("previous"))).alias("_prev"))
    s = F.col("_seed")
    findings = F.when(s % 29 == 0, F.array().cast(
        "array<struct<kpi_id:string,direction:string,magnitude_pct:double,context:string>>")).otherwise(
        F.transform(F.array_sort("_f"), lambda x: F.struct(
            x["kpi_id"].alias("kpi_id"), x["direction"].alias("direction"),
            x["magnitude_pct"].alias("magnitude_pct"), x["context"].alias("context"))))
    verb = F.when((F.col("_pct") > 0) != (s % 6 == 0), F.lit("rose")).otherwise(F.lit("fell"))
    num = (F.floor(F.abs("_pct")) + F.when(s % 19 == 0, F.lit(25)).otherwise(F.lit(0))).cast("string")
    headline = F.concat(F.lit("Revenue "), verb, F.lit(" "), num, F.lit("%"))
    headline = F.when(s % 23 == 0, F.concat(F.lit("[AI UNAVAILABLE] "), headline)).otherwise(headline)
    cur_txt = (F.when(s % 4 == 0, F.concat(F.lit("€"), (F.floor(F.col("_cur") / 1e5) / 10).cast("string"), F.lit("M")))
               .when(s % 8 == 1, F.concat(F.lit("€"), _amount(F.col("_cur") * 3)))
               .otherwise(F.concat(F.lit("€"), _amount(F.col("_cur")))))
    summary = F.concat(F.lit("Total revenue reached "), cur_txt, F.lit(" against €"), _amount(F.col("_prev")),
                       F.lit(" in the prior month."))
    n_claims = F.when(s % 9 == 0, 0).when(s % 10 == 0, 1).otherwise(2)
    claim = F.struct(F.lit("price mix").alias("claim"), F.lit("total_revenue").alias("evidence_kpi"),
                     F.col("_pct").cast("string").alias("evidence_value"))
    claims = F.slice(F.array(claim, claim), 1, n_claims)
    rca = F.struct(claims.alias("claims"), F.array().cast("array<string>").alias("unsupported_factors"))
    return per.select("client", "period", headline.alias("headline"), summary.alias("executive_summary"),
                      findings.alias("key_findings"), rca.alias("rca"),
                      F.array().cast("array<string>").alias("risks"),
                      F.array().cast("array<string>").alias("opportunities"),
                      F.lit("").alias("outlook"))


def _sql_case(mapping: dict[str, str]) -> str:
    parts = " ".join(f"WHEN ends_with(kpi, '_{m}') THEN '{t}'" for m, t in mapping.items())
    return f"CASE {parts} ELSE 'the market moved' END"


def commentary_sql() -> str:
    """CTEs ``cseed``, ``finding(client, period, idx, kpi_id, direction, magnitude_pct, context)`` and
    ``comm(client, period, seed, headline, executive_summary, n_findings, n_claims)`` (needs ``delta``)."""
    k = "(seed + kpi_ord)"
    base_dir = "CASE WHEN abs(pct) < 3 THEN 'flat' WHEN pct > 0 THEN 'up' ELSE 'down' END"
    flipped = f"CASE WHEN {base_dir} = 'up' THEN 'down' WHEN {base_dir} = 'down' THEN 'up' ELSE 'up' END"
    return f""",
cseed AS (SELECT *, CAST(substr(period, 1, 4) AS INTEGER) * 12 + CAST(substr(period, 6, 2) AS INTEGER)
                    + length(client) AS seed FROM delta),
finding AS (
  SELECT client, period, CAST(row_number() OVER (PARTITION BY client, period ORDER BY kpi_ord) - 1 AS INTEGER) AS idx,
         CASE WHEN {k} % 17 = 0 THEN '' WHEN {k} % 13 = 0 THEN kpi || '_ytd' ELSE kpi END AS kpi_id,
         CASE WHEN {k} % 11 = 0 THEN {flipped} ELSE {base_dir} END AS direction,
         abs(pct) + CASE WHEN {k} % 7 = 0 THEN 7.5 ELSE 0.0 END AS magnitude_pct,
         CASE WHEN {k} % 5 = 0 THEN {_sql_case(CONTEXT_LEAK)} ELSE {_sql_case(CONTEXT_OWN)} END AS context
  FROM cseed WHERE kpi_ord <= 5 AND seed % 29 <> 0),
rep AS (
  SELECT client, period, any_value(seed) AS seed,
         max(CASE WHEN kpi = 'total_revenue' THEN pct END) AS rpct,
         max(CASE WHEN kpi = 'total_revenue' THEN current END) AS rcur,
         max(CASE WHEN kpi = 'total_revenue' THEN previous END) AS rprev
  FROM cseed GROUP BY client, period),
comm AS (
  SELECT client, period, seed,
    CASE WHEN seed % 23 = 0 THEN '[AI UNAVAILABLE] ' ELSE '' END || 'Revenue ' ||
      CASE WHEN (rpct > 0) <> (seed % 6 = 0) THEN 'rose' ELSE 'fell' END || ' ' ||
      CAST(CAST(floor(abs(rpct)) + CASE WHEN seed % 19 = 0 THEN 25 ELSE 0 END AS BIGINT) AS VARCHAR) || '%' AS headline,
    'Total revenue reached ' ||
      CASE WHEN seed % 4 = 0 THEN '€' || CAST(floor(rcur / 1e5) / 10 AS VARCHAR) || 'M'
           WHEN seed % 8 = 1 THEN '€' || format('{{:,}}', CAST(floor(rcur * 3) AS BIGINT))
           ELSE '€' || format('{{:,}}', CAST(floor(rcur) AS BIGINT)) END ||
      ' against €' || format('{{:,}}', CAST(floor(rprev) AS BIGINT)) || ' in the prior month.' AS executive_summary,
    CASE WHEN seed % 29 = 0 THEN 0 ELSE (SELECT count(*) FROM cseed x WHERE x.client = rep.client
         AND x.period = rep.period AND x.kpi_ord <= 5) END AS n_findings,
    CASE WHEN seed % 9 = 0 THEN 0 WHEN seed % 10 = 0 THEN 1 ELSE 2 END AS n_claims
  FROM rep)"""
