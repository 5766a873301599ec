"""Registered queries over inputs that are bad on purpose: malformed periods, missing commentary, hostile keys, long and
cyclic chains, stored fingerprints and suites, payloads compared value by value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as NU
from ..functions import parse as PA
from ..functions import text as TX
from ..operators import audit as AU
from ..operators import clean_month as CM
from ..operators import dates as D
from ..operators import gate as G
from ..operators import golden as GD
from ..operators import joins as J
from ..operators import messages as MS
from ..operators import profile as P
from ..operators import snapshot as snap
from ..session import ensure_checkpoint_dir
from ..sources import sinks as SK
from ..sources.testdata import MEASURES, SCHEMAS, table
from . import catalog as CA
from . import exports as EX
from . import ledger as LG
from . import sqltext as Q
from .registry import query

_FEB = "CASE WHEN substr(period, 6, 2) = '02' THEN substr(period, 1, 4) || '-99' ELSE period END"


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- A9 D6: periods that are no months

def _bad_period_kpis(spark, sf) -> DataFrame:
    bad = F.when(F.substring("period", 6, 2) == "02", F.concat(F.substring("period", 1, 4), F.lit("-99"))).otherwise(F.col("period"))
    return CA.kpis(spark, sf).withColumn("period", bad)


@query("kpi_delta_bad_periods", Q.base(f"bad AS (SELECT * REPLACE ({_FEB} AS period) FROM kpi)", Q.delta_cte(1, "d2").replace("kpi c JOIN kpi p", "bad c JOIN bad p")) + "SELECT * FROM d2")
def q_bad_period_deltas(spark, sf):
    return snap.kpi_delta(_bad_period_kpis(spark, sf))


@query("invalid_periods", Q.base(f"bad AS (SELECT DISTINCT client, {_FEB} AS period FROM kpi)") + """
SELECT client, period, 'INVALID_PERIOD' AS code, 'block' AS severity, 'Period ''' || period || ''' is not a month (yyyy-MM).' AS message
FROM bad WHERE period LIKE '%-99'""")
def q_invalid_periods(spark, sf):
    return snap.invalid_periods(_bad_period_kpis(spark, sf))


# ---------------------------------------------------------------- B5: date forms

_FORMS = [("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd.MM.yy", "%d.%m.%y"),
          ("dd/MM/yyyy", "%d/%m/%Y"), ("dd-MM-yy", "%d-%m-%y"), ("'no date' yyyy", "no date %Y")]


@query("date_forms", "SELECT o_orderkey, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate + INTERVAL 30 YEAR, '{d}')" for i, (_, d) in enumerate(_FORMS))
       + " END AS text, CASE WHEN o_orderkey % 7 <> 6 THEN o_orderdate + INTERVAL 30 YEAR END AS parsed FROM orders")
def q_date_forms(spark, sf):
    text = None
    later = F.col("o_orderdate") + F.expr("INTERVAL 30 YEAR")  # two-digit years are of this century
    for i, (form, _) in enumerate(_FORMS):
        when = F.col("o_orderkey") % 7 == i
        text = F.when(when, F.date_format(later, form)) if text is None else text.when(when, F.date_format(later, form))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text")).withColumn("parsed", D.parse_date(F.col("text")).cast("timestamp_ntz"))


# ---------------------------------------------------------------- D9: an explicit column that some reports lack

@query("date_pick_explicit", Q.base() + """SELECT DISTINCT client, period, CAST(NULL AS VARCHAR) AS date_column, 'explicit_not_found' AS status, CAST(0 AS BIGINT) AS n_passing FROM fact""")
def q_date_pick_explicit(spark, sf):
    st = CA._date_stats(spark, sf)
    return D.pick_date_column(D.date_summary(st, D.date_issues(st)), explicit="no_such_column")


# ---------------------------------------------------------------- E12 Q9: reports without commentary or findings

@query("gate_missing_commentary", CA._GATE_BASE + """SELECT client, period, 'commentary' AS gate_check, 'NO_COMMENTARY' AS code, 'block' AS severity, '' AS subject, CAST(NULL AS DOUBLE) AS metric
FROM comm WHERE seed % 8 = 0
UNION ALL SELECT client, period, 'findings', 'NO_FINDINGS', 'warn', '', NULL FROM comm WHERE seed % 8 <> 0 AND (seed % 9 = 0 OR n_findings = 0)""")
def q_missing_commentary(spark, sf):
    _, d, c, _ = CA.gate_inputs(spark, sf)
    s = F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int") + F.length("client")
    c = c.where(s % 8 != 0).withColumn("key_findings", F.when(s % 9 != 0, F.col("key_findings")))
    return G.missing_commentary_flags(d, c).unionByName(G.findings_flags(c, d).where("code = 'NO_FINDINGS'"))


# ---------------------------------------------------------------- F13: a chain of all reports, and cycles

def _with_previous(ids: DataFrame, col: str, out: str) -> DataFrame:
    """``ids`` with ``out``: the value of ``col`` before it in the order of the whole table, which no single task sorts.

    Inside a range it is the row before; the first row of a range takes the last of the ranges before (one row a range).
    """
    ensure_checkpoint_dir(ids.sparkSession)
    ranged = ids.orderBy(col).withColumn("_range", F.spark_partition_id()).checkpoint()
    inside = ranged.withColumn("_before", F.lag(col).over(Window.partitionBy("_range").orderBy(col)))
    lasts = ranged.groupBy("_range").agg(F.max(col).alias("_last")).withColumn("_link", F.lag("_last").over(Window.orderBy("_range")))  # one row a range
    return inside.join(J.broadcast_if_small(lasts.select("_range", "_link").checkpoint()), "_range").withColumn(out, F.coalesce("_before", "_link")).drop("_range", "_before", "_link")


@query("supersedes_long_chain", Q.base() + """SELECT id AS report_id, first_value(id) OVER w AS root_id, CAST(row_number() OVER w - 1 AS BIGINT) AS depth, false AS cyclic
FROM (SELECT DISTINCT client || '/' || period AS id FROM snap) WINDOW w AS (ORDER BY id)
UNION ALL SELECT DISTINCT client || s, NULL, NULL, true FROM snap, (VALUES ('#a'), ('#b'), ('#c')) v(s)""")
def q_long_chain(spark, sf):
    ids = CA._agg(spark, sf).select("client", F.concat_ws("/", "client", "period").alias("report_id"))
    chain = _with_previous(ids.select("report_id"), "report_id", "supersedes")  # one row for each report
    turns = F.array(F.struct(F.lit("#a").alias("s"), F.lit("#b").alias("t")), F.struct(F.lit("#b").alias("s"), F.lit("#a").alias("t")), F.struct(F.lit("#c").alias("s"), F.lit("#b").alias("t")))
    cycles = ids.select("client").distinct().select("client", F.inline(turns)).select(F.concat("client", "s").alias("report_id"), F.concat("client", "t").alias("supersedes"))
    return AU.supersedes_chain(spark, chain.unionByName(cycles))


# ---------------------------------------------------------------- M13 F10: eligibility at an anchor month

ANCHOR = "1999-03"


@query("eligibility_at_anchor", CA._LEDGER + f""", bounds AS (SELECT client_name, min(CAST(period || '-01' AS DATE)) AS lo, greatest(max(CAST(period || '-01' AS DATE)), DATE '1999-02-01') AS hi FROM audit GROUP BY client_name),
sp2 AS (SELECT client_name, strftime(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)), '%Y-%m') AS period FROM bounds),
w AS (SELECT s.client_name, count(*) AS n, count(*) FILTER (WHERE COALESCE(c.is_clean, false)) AS k FROM sp2 s LEFT JOIN cm c ON c.client_name = s.client_name AND c.period = s.period
  WHERE s.period BETWEEN '1998-09' AND '1999-02' GROUP BY s.client_name)
SELECT client_name, '{ANCHOR}' AS anchor_month, k AS clean_in_window, k = 6 AND n = 6 AS eligible, CASE WHEN k = 6 AND n = 6 THEN 'Spot-Check' ELSE 'Reviewed' END AS tier FROM w""")
def q_eligibility_at(spark, sf):
    audit, corr, *_ = CA.ledger_inputs(spark, sf)
    return CM.eligibility_at(audit, corr, ANCHOR)


# ---------------------------------------------------------------- K1: numbers with white space of every kind

@query("number_spaces", """SELECT o_orderkey, CAST(o_orderkey % 90 AS DOUBLE) AS value, true AS is_pct FROM orders""")
def q_number_spaces(spark, sf):
    gaps = F.array(*[F.lit(g) for g in ("", " ", "\u00a0", "\u2009", "\u3000", "\t")])
    text = F.concat(F.lit("margin "), (F.col("o_orderkey") % 90).cast("string"), F.element_at(gaps, (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit("% of sales"))
    return table(spark, sf, "orders").select("o_orderkey", F.inline(NU.number_tokens(text))).select("o_orderkey", "value", "is_pct")


# ---------------------------------------------------------------- K12: root cause as text, lists, unreadable magnitudes

@query("parse_full_response", Q.base() + """SELECT client, period, 1 AS n_findings, 'Weather, mostly in ' || period AS unsupported, 0 AS n_claims, 'r1|r2' AS risks, client AS opportunities, '' AS actions, 'calm' AS outlook
FROM (SELECT DISTINCT client, period FROM snap)""")
def q_parse_full(spark, sf):
    s = CA._agg(spark, sf).select("client", "period")
    raw = F.concat(F.lit('{"headline": "h", "key_findings": [{"kpi_id": "a", "magnitude_pct": "much"}, {"kpi_id": "b", "magnitude_pct": 2}], "root_cause_analysis": "Weather, mostly in '),
                   "period", F.lit('", "risks": ["r1", "r2"], "opportunities": ["'), "client", F.lit('"], "outlook": "calm"}'))
    p = s.select("client", "period", PA.parse_response(raw).alias("p"))
    return p.select("client", "period", F.size("p.key_findings").alias("n_findings"), F.array_join("p.rca.unsupported_factors", "|").alias("unsupported"), F.size("p.rca.claims").alias("n_claims"),
                    F.array_join("p.risks", "|").alias("risks"), F.array_join("p.opportunities", "|").alias("opportunities"), F.array_join("p.recommended_actions", "|").alias("actions"),
                    F.col("p.outlook").alias("outlook"))


# ---------------------------------------------------------------- A13: fingerprint store, first runs

_STORED = [("period", "string", False, "period"), ("revenue", "decimal(38,4)", True, "revenue"), ("quantity", "decimal(18,2)", True, "quantity"),
           ("l_returnflag", "string", False, "CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END")]


@query("fingerprint_store", Q.base() + " UNION ALL ".join(f"""SELECT 'fact' AS table_name, client, '{c}' AS column_name, {i + 1} AS ord, '{t}' AS dtype, {str(num).lower()} AS is_numeric, false AS is_datetime,
  count(*) AS row_count, count(DISTINCT {v}) AS cardinality, count(*) - count({v}) AS null_count, (count(*) - count({v})) / count(*) AS null_rate FROM fact GROUP BY client"""
                                              for i, (c, t, num, v) in enumerate(_STORED)))
def q_fingerprint_store(spark, sf):
    """Two approvals and a first run: what is loaded again is what was written, one record for each client and column."""
    f = CA._fact(spark, sf).select("client", "period", "revenue", "quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("l_returnflag"))
    now = P.profile({"fact": f}, group="client", samples=False).checkpoint()
    path = _scratch(spark, "fingerprints")
    SK.write_fingerprint(now.where(F.length("client") % 2 == 0), path)
    stored = SK.load_fingerprint(spark, path, now.schema)
    SK.write_fingerprint(SK.first_runs(now, stored), path)
    return SK.load_fingerprint(spark, path, now.schema)


# ---------------------------------------------------------------- A16: suites keep all their columns

@query("suite_round_trip", Q.base().rstrip() + CA._GOLDEN_CTES + """SELECT client, period, measure_name, expected_value, 'All data, no filter' AS filter_context, 'note ' || client AS notes, '2001-09-01' AS verified_at
FROM gv JOIN gs USING (client)""")
def q_suite_round_trip(spark, sf):
    _, values, signoff = CA.golden_inputs(spark, sf)
    path = _scratch(spark, "suite")
    GD.save_suite(values.withColumns({"filter_context": F.lit("All data, no filter"), "notes": F.concat(F.lit("note "), "client")}), signoff.withColumn("verified_at", F.lit("2001-09-01")), path)
    v, s = GD.load_suite(spark, path)
    return v.join(s.select("client", "verified_at"), "client").select("client", "period", "measure_name", "expected_value", "filter_context", "notes", "verified_at")


# ---------------------------------------------------------------- A10 A11 G3: log round trip

@query("audit_round_trip", CA._LEDGER + "SELECT report_id, client_name, period, generated_at, late_correction, delivery FROM audit")
def q_audit_round_trip(spark, sf):
    audit = CA.ledger_inputs(spark, sf)[0]
    path = _scratch(spark, "audit")
    AU.write_log(audit, path)
    return AU.read_log(spark, path).select("report_id", "client_name", "period", "generated_at", "late_correction", "delivery")


# ---------------------------------------------------------------- A18-A20: payloads, value by value

@query("snapshot_json_values", Q.base() + "SELECT client, period, kpi, value FROM kpi")
def q_snapshot_values(spark, sf):
    made = CA.q_snapshot_json(spark, sf)
    return made.select("client", "period", F.explode(F.from_json("json", "kpis MAP<STRING, DOUBLE>")["kpis"]).alias("kpi", "value"))


@query("snapshot_json_breakdowns", CA._BREAKDOWN_SQL.replace("SELECT * FROM (", "SELECT client, period, dim, dim_value, value FROM (", 1))
def q_snapshot_breakdowns(spark, sf):
    made = CA.q_snapshot_json(spark, sf).select("client", "period", F.from_json("json", "dimension_breakdowns MAP<STRING, MAP<STRING, DOUBLE>>")["dimension_breakdowns"].alias("b"))
    return made.select("client", "period", F.explode("b").alias("dim", "m")).select("client", "period", "dim", F.explode("m").alias("dim_value", "value"))


@query("prompt_context_values", Q.base() + "SELECT client, period, kpi, current, previous, abs, pct FROM delta")
def q_prompt_values(spark, sf):
    made = CA.q_prompt_context(spark, sf)
    schema = "kpi_deltas MAP<STRING, STRUCT<current: DOUBLE, previous: DOUBLE, abs: DOUBLE, pct: DOUBLE>>"
    return made.select("client", "period", F.explode(F.from_json("json", schema)["kpi_deltas"]).alias("kpi", "v")).select("client", "period", "kpi", "v.*")


@query("prompt_context_equal_keys", Q.base() + """SELECT DISTINCT client, period, 'dim' AS dim, 'A' AS dim_value, CAST(1 AS DOUBLE) AS value FROM delta""")
def q_prompt_equal_keys(spark, sf):
    """Two values that clean to one key: the payload keeps the later one, and no job stops."""
    _, d, _, _ = CA.gate_inputs(spark, sf)
    twins = d.select("client", "period").distinct().select("client", "period", F.lit("dim").alias("dim"), F.inline(F.array(
        F.struct(F.lit("A").alias("dim_value"), F.lit(2.0).alias("value"), F.lit(1).alias("rnk")), F.struct(F.lit("A\u200b").alias("dim_value"), F.lit(1.0).alias("value"), F.lit(2).alias("rnk")))))
    made = EX._breakdown_maps(twins, clean_keys=True)
    return made.select("client", "period", F.explode("breakdowns").alias("dim", "m")).select("client", "period", "dim", F.explode("m").alias("dim_value", "value"))


@query("held_packet_flags", CA._FULL + f""", flags AS ({CA._ALL_FLAGS}), held AS (SELECT client, period FROM flags GROUP BY client, period HAVING count(*) FILTER (WHERE severity = 'block') > 0)
SELECT f.client, f.period, f.severity, f.code, f.subject FROM flags f JOIN held h ON h.client = f.client AND h.period = f.period""")
def q_held_flags(spark, sf):
    made = CA.q_held_packets(spark, sf)
    kind = "ARRAY<STRUCT<code: STRING, subject: STRING>>"
    r = made.select("client", "period", F.from_json("json", f"review STRUCT<blockers: {kind}, warnings: {kind}>")["review"].alias("r"))
    both = F.flatten(F.array(F.transform("r.blockers", lambda x: F.struct(F.lit("block").alias("severity"), x["code"].alias("code"), x["subject"].alias("subject"))),
                             F.transform("r.warnings", lambda x: F.struct(F.lit("warn").alias("severity"), x["code"].alias("code"), x["subject"].alias("subject")))))
    return r.select("client", "period", F.inline(both))


# ---------------------------------------------------------------- Q1-Q15: text of the flags

_THRESHOLD = """CASE WHEN t.threshold_pct IS NULL THEN 'threshold=15.0% (static fallback — no history)'
  ELSE 'threshold=' || printf('%.1f', t.threshold_pct) || '% (' || t.method || ', n=' || t.history_count || ')' END"""
_RATIO = "'Current row count (' || format('{:,}', p.row_count) || ') is ' || CAST(round(f.metric * 100) AS BIGINT) || '% of previous (' || format('{:,}', p.prev_row_count) || ')'"
_AT = "'key_finding[' || n.idx || ']'"


@query("gate_messages", CA._FULL + f""", flags AS ({CA._ALL_FLAGS})
SELECT f.client, f.period, f.code, f.severity, f.subject, CASE f.code
  WHEN 'ROW_COUNT_DROP' THEN {_RATIO} || ' — likely truncated source file' WHEN 'ROW_COUNT_LOW' THEN {_RATIO} WHEN 'ROW_COUNT_SPIKE' THEN {_RATIO}
  WHEN 'PERIOD_LENGTH_MISMATCH' THEN 'Period coverage differs by ' || CAST(f.metric AS BIGINT) || ' days (current=' || p.period_days || ', previous=' || p.prev_period_days || ')'
  WHEN 'ANOMALOUS_DELTA' THEN d.kpi || ' changed ' || printf('%+.1f', f.metric) || '% — exceeds ' || {_THRESHOLD}
  WHEN 'NOTABLE_DELTA' THEN d.kpi || ' changed ' || printf('%+.1f', f.metric) || '% — above 60% of ' || {_THRESHOLD}
  WHEN 'MALFORMED_FINDING' THEN {_AT} || ' has empty kpi_id — likely legacy prose format'
  WHEN 'UNKNOWN_KPI' THEN {_AT} || ' references kpi_id=''' || n.kpi_id || ''' which is not in source data'
  WHEN 'FINDING_DIRECTION_MISMATCH' THEN {_AT} || ' for ''' || n.kpi_id || ''' says ''' || n.direction || ''' but source pct is ' || printf('%+.1f', d.pct) || '% (direction='''
    || CASE WHEN abs(d.pct) < 3 THEN 'flat' WHEN d.pct > 0 THEN 'up' ELSE 'down' END || ''')'
  WHEN 'FINDING_MAGNITUDE_MISMATCH' THEN {_AT} || ' for ''' || n.kpi_id || ''' claims ' || printf('%.1f', n.magnitude_pct) || '% but source is ' || printf('%.1f', abs(d.pct)) || '% (delta ' || printf('%.1f', f.metric) || 'pp)'
  WHEN 'CONTEXT_KPI_LEAK' THEN {_AT} || ' for ''' || n.kpi_id || ''' mentions other KPI tokens in context'
  WHEN 'NUMERIC_MISMATCH' THEN 'Commentary states ''' || f.subject || ''' but the nearest source KPI deviates by ' || printf('%.1f', f.metric) || 'pp'
  WHEN 'NUMERIC_APPROXIMATION' THEN 'Commentary states ''' || f.subject || '''; the nearest KPI is ' || printf('%.1f', f.metric) || 'pp off'
  WHEN 'UNVERIFIABLE_ABSOLUTE' THEN 'Value ''' || f.subject || ''' does not match any source KPI within 2.0%'
  WHEN 'DIRECTION_CONFLICT' THEN 'Commentary says revenue ' || CASE WHEN f.metric > 0 THEN 'fell' ELSE 'grew' END || ' but ' || f.subject || ' is ' || printf('%+.1f', f.metric) || '%'
  WHEN 'NO_FINDINGS' THEN 'key_findings is empty — report has no headline movements'
  WHEN 'NO_CITATIONS' THEN 'root_cause_analysis has zero KPI-backed claims — all factors are unsupported'
  WHEN 'WEAK_CITATION' THEN 'Only 1 cited claim(s) — verify it''s sufficient for the narrative'
  WHEN 'ROUND_NUMBER' THEN replace(f.subject, ':', ' ') || ' is suspiciously round (' || CAST(f.metric AS VARCHAR) || ')'
  WHEN 'FALLBACK_COMMENTARY' THEN 'Commentary is the API-unavailable fallback — do not deliver' END AS message
FROM flags f LEFT JOIN pair p ON p.client = f.client AND p.period = f.period
LEFT JOIN finding n ON f.gate_check = 'findings' AND n.client = f.client AND n.period = f.period AND f.subject = 'key_finding[' || n.idx || ']'
LEFT JOIN delta d ON d.client = f.client AND d.period = f.period AND d.kpi = COALESCE(n.kpi_id, f.subject)
LEFT JOIN thr t ON t.client = f.client AND t.kpi = COALESCE(n.kpi_id, f.subject)""")
def q_gate_messages(spark, sf):
    pair, d, c, thr = CA.gate_inputs(spark, sf)
    flags = G.run_gate(pair, d, c, CA.S.default_synonyms(spark), thr).checkpoint()
    return MS.with_messages(flags, pair, d, c, thr).select("client", "period", "code", "severity", "subject", "message")


# ---------------------------------------------------------------- K11 Q14: round values

@query("round_number_planted", Q.base() + """SELECT client, period, 'round_number' AS gate_check, 'ROUND_NUMBER' AS code, 'warn' AS severity, kpi || ':current' AS subject,
  CASE kpi_ord % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 100.0 WHEN 2 THEN -1000.0 ELSE 10000.04 END AS metric FROM delta""")
def q_round_planted(spark, sf):
    d = CA.deltas(spark, sf)
    o = F.col("kpi_ord") % 4
    value = F.when(o == 0, 0.0).when(o == 1, 100.0).when(o == 2, -1000.0).otherwise(10000.04)
    return G.round_number_flags(d.withColumns({"current": value, "previous": F.lit(123.4)}))


# ---------------------------------------------------------------- C8 C9: drift against an empty export

@query("drift_empty_export", " UNION ALL ".join(f"""SELECT 'lineitem' AS table_name, '{c}' AS column_name, count(*) AS previous_rows, count(DISTINCT {c}) AS previous_values, CAST(0 AS BIGINT) AS current_rows,
  CAST(0 AS BIGINT) AS events FROM lineitem""" for c, _ in SCHEMAS["lineitem"]))
def q_drift_empty(spark, sf):
    """An empty export has all its columns: none of them is missing, and nothing drifted."""
    li = table(spark, sf, "lineitem")
    before, now = P.profile({"lineitem": li}, samples=False), P.profile({"lineitem": li.where("l_orderkey < 0")}, samples=False)
    n = P.drift(before, now).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    j = before.select("table_name", "column_name", F.col("row_count").alias("previous_rows"), F.col("cardinality").alias("previous_values")).join(
        now.select("column_name", F.col("row_count").alias("current_rows")), "column_name").join(n, "column_name", "left")
    return j.select("table_name", "column_name", "previous_rows", "previous_values", "current_rows", F.coalesce("n", F.lit(0)).cast("long").alias("events"))


# ---------------------------------------------------------------- F9 J4: alternatives of several words

@query("phrase_leaks", Q.base() + """SELECT client, period, 0 AS idx, 'total_quantity' AS kpi_id, 'bottom line,top-line' AS leaked
FROM delta WHERE kpi = 'total_quantity'""")
def q_phrase_leaks(spark, sf):
    """Clients call revenue the bottom line, or top-line: both are found in a context, whole, and no part of a word is."""
    d = CA.deltas(spark, sf).select("client", "period", "kpi")
    own = d.select("client").distinct().select("client", F.lit("revenue").alias("token"), F.explode(F.array(F.lit("bottom line"), F.lit("top-line"), F.lit("line it"))).alias("alt"))
    findings = d.where("kpi = 'total_quantity'").select("client", "period", F.lit(0).alias("idx"), F.col("kpi").alias("kpi_id"),
                                                        F.lit("The Bottom Line fell, the top-line too; headline items rose.").alias("context"))
    return CA.S.leaks(findings, d, CA.S.default_synonyms(spark), own)


# ---------------------------------------------------------------- K4: root cause as prose

@query("root_cause_prose", Q.base() + """SELECT client, period, CASE row_count % 3
  WHEN 0 THEN '[No causal claims could be grounded in the data.]'
  WHEN 1 THEN 'More orders (row_count: ' || row_count || ')'
  ELSE 'More orders (row_count: ' || row_count || ') Possible contributing factors (unverified from data): weather; ' || client END AS prose FROM snap""")
def q_root_cause_prose(spark, sf):
    s = snap.snapshot_from_aggregate(CA._agg(spark, sf))
    n = F.col("row_count")
    claim = F.array(F.struct(F.lit("More orders").alias("claim"), F.lit("row_count").alias("evidence_kpi"), n.cast("string").alias("evidence_value")))
    factors = F.array(F.lit("weather"), F.col("client"))
    rca = F.struct(F.when(n % 3 > 0, claim).alias("claims"), F.when(n % 3 == 2, factors).alias("unsupported_factors"))
    return s.withColumn("rca", rca).select("client", "period", TX.root_cause_prose(F.col("rca")).alias("prose"))


# ---------------------------------------------------------------- M4: the full audit record

@query("audit_full_record", CA._LEDGER + f"""{CA._COST_CTES.replace(", d.k ", ", d.k ")}
SELECT a.report_id, a.seq, d.kpi, d.current, d.pct, COALESCE(t.threshold_pct, 15.0) AS threshold_pct, 'text-model-1' AS model, 'o_orderdate' AS date_column_used,
  round(c.eur, 6) AS cost_eur
FROM audit a JOIN delta d ON d.client = a.client_name AND d.period = a.period LEFT JOIN thr t ON t.client = d.client AND t.kpi = d.kpi
JOIN (SELECT client_name, period, sum(usd / 1.08) AS eur FROM costs GROUP BY client_name, period) c ON c.client_name = a.client_name AND c.period = a.period""")
def q_audit_full_record(spark, sf):
    audit, _, d, sn = CA.ledger_inputs(spark, sf)
    thr = CA.V.thresholds(CA.V.history_from_deltas(d))
    full = AU.complete_record(audit, d, thr, LG.derive_costs(d, sn), "o_orderdate")
    one = full.select("report_id", "seq", "model", "date_column_used", "cost_eur", "volatility_thresholds", F.explode("kpi_snapshot").alias("kpi", "v"))
    return one.select("report_id", "seq", "kpi", F.col("v")["current"].alias("current"), F.col("v")["pct"].alias("pct"),
                      F.try_element_at("volatility_thresholds", F.col("kpi")).alias("threshold_pct"), "model", "date_column_used", "cost_eur")


# ---------------------------------------------------------------- F11: dimension keys that repeat

_TWIN_SQL = "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name || ' (copy)' FROM supplier WHERE s_suppkey % 4 = 0"


def _twin_suppliers(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return s.unionByName(s.where("s_suppkey % 4 = 0").withColumn("s_name", F.concat("s_name", F.lit(" (copy)"))))


@query("dim_repeated_keys", f"SELECT s_suppkey, count(*) AS rows FROM ({_TWIN_SQL}) GROUP BY s_suppkey HAVING count(*) > 1")
def q_repeated_keys(spark, sf):
    return J.repeated_keys(_twin_suppliers(spark, sf), ["s_suppkey"])


@query("dim_join_unique", Q.base(f"d AS (SELECT s_suppkey, min(s_name) AS s_name FROM ({_TWIN_SQL}) GROUP BY s_suppkey)") + """
SELECT f.client, d.s_name, CAST(sum(f.revenue) AS DOUBLE) AS value, count(*) AS lines FROM fact f JOIN d ON d.s_suppkey = f.l_suppkey GROUP BY f.client, d.s_name""")
def q_dim_join_unique(spark, sf):
    """Facts joined to a dimension with repeated keys are not multiplied."""
    dim = J.unique_dim(_twin_suppliers(spark, sf), ["s_suppkey"], ["s_name"]).withColumnRenamed("s_suppkey", "l_suppkey")
    fact = CA._fact(spark, sf).groupBy("client", "l_suppkey").agg(F.sum("revenue").alias("r"), F.count(F.lit(1)).alias("n"))
    return J.join_dim(fact, dim, "l_suppkey").groupBy("client", "s_name").agg(F.sum("r").cast("double").alias("value"), F.sum("n").alias("lines"))
