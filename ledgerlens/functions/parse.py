"""Parse raw commentary responses (JSON text) into the commentary struct, without a UDF.

Code fences are stripped, the outermost ``{...}`` is taken when the text has a
preamble, and findings given in the legacy string form become findings with
an empty KPI id (the gate then reports them as malformed). Findings whose
magnitude is no number are skipped. A root cause given as plain text has no
citation: it becomes one unsupported factor. Mixed lists are read through the
VARIANT type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"```[a-z]*\n?"
OBJECT = r"(?s)\{.*\}"
CLAIMS_T = "array<struct<claim:string,evidence_kpi:string,evidence_value:string>>"


def _get(v: Column, path: str, t: str = "string") -> Column:
    return F.try_variant_get(v, path, t)


def parse_response(raw: Column) -> Column:
    """STRUCT(headline, executive_summary, key_findings, rca, risks, opportunities, recommended_actions, outlook)
    from a raw response text."""
    t = F.trim(F.regexp_replace(raw, FENCE, ""))
    v = F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, OBJECT, 0)))

    def readable(x: Column) -> Column:
        named = F.try_variant_get(x, "$.magnitude_pct", "variant").isNotNull()
        return ~named | _get(x, "$.magnitude_pct", "double").isNotNull()

    def texts(path: str) -> Column:
        return F.coalesce(_get(v, path, "array<string>"), F.array().cast("array<string>"))

    def finding(x: Column) -> Column:
        is_obj = F.schema_of_variant(x).startswith("OBJECT")
        return F.when(is_obj, F.struct(
            F.trim(F.coalesce(_get(x, "$.kpi_id"), F.lit(""))).alias("kpi_id"),
            F.lower(F.trim(F.coalesce(_get(x, "$.direction"), F.lit("flat")))).alias("direction"),
            F.coalesce(_get(x, "$.magnitude_pct", "double"), F.lit(0.0)).alias("magnitude_pct"),
            F.trim(F.coalesce(_get(x, "$.context"), F.lit(""))).alias("context"))).otherwise(F.struct(
                F.lit("").alias("kpi_id"), F.lit("flat").alias("direction"), F.lit(0.0).alias("magnitude_pct"),
                F.coalesce(_get(x, "$"), F.lit("")).alias("context")))

    kf = F.coalesce(_get(v, "$.key_findings", "array<variant>"), F.array().cast("array<variant>"))
    claims = F.coalesce(_get(v, "$.root_cause_analysis.claims", CLAIMS_T), F.array().cast(CLAIMS_T))
    plain = F.when(_get(v, "$.root_cause_analysis.claims", "variant").isNull()
                   & _get(v, "$.root_cause_analysis.unsupported_factors", "variant").isNull(),
                   F.nullif(F.trim(_get(v, "$.root_cause_analysis")), F.lit("")))
    no_object = ~F.coalesce(F.schema_of_variant(_get(v, "$.root_cause_analysis", "variant")).startswith("OBJECT"), F.lit(False))
    unsupported = F.when(no_object & plain.isNotNull(), F.array(plain)).otherwise(texts("$.root_cause_analysis.unsupported_factors"))
    return F.struct(
        F.coalesce(_get(v, "$.headline"), F.lit("")).alias("headline"),
        F.when(v.isNull(), t).otherwise(F.coalesce(_get(v, "$.executive_summary"), F.lit(""))).alias("executive_summary"),
        F.transform(F.filter(kf, readable), finding).alias("key_findings"),
        F.struct(claims.alias("claims"), unsupported.alias("unsupported_factors")).alias("rca"),
        texts("$.risks").alias("risks"), texts("$.opportunities").alias("opportunities"),
        texts("$.recommended_actions").alias("recommended_actions"), F.coalesce(_get(v, "$.outlook"), F.lit("")).alias("outlook"))
