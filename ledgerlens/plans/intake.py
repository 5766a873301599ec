"""Registered queries over what comes in: records over several lines, nested payloads, stored sketches, logs with damage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import audit as AU
from ..operators import dates as D
from ..operators import gate as G
from ..operators import golden_filters as GF
from ..operators import messages as MS
from ..operators import payloads as PL
from ..operators import profile as P
from ..operators import pseudonyms as PS
from ..operators import sketch as SK
from ..operators.spread import spread
from ..sources import render as RN
from ..sources import scan as SC
from ..sources import sinks as SI
from ..sources.testdata import table
from . import catalog as CA
from . import sqltext as Q
from .hardened import _scratch
from .registry import query

# ---------------------------------------------------------------- A1 A4: quoted cells that run over several lines

_NOTES = {0: "plain", 1: "a;b", 2: "line one\nline two", 3: 'say "hi"\n\nthen; more', 4: '5" pipe', 5: "\nbegins and ends\n"}
_NOTE_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN " + "'" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in _NOTES.items()) + " END"
_NOTE_FILE = "'exports/notes_' || lower(o_orderstatus) || '.csv'"
_OPEN_LINES = ('9;"never closed', "1;x;y", '2;"";z')


def note_lines(spark, sf) -> DataFrame:
    """An export for each order status; that of status P ends with a cell that is never closed."""
    o = spread(table(spark, sf, "orders"), "o_orderkey")
    note = None
    for k, v in _NOTES.items():
        when = F.col("o_orderkey") % 6 == k
        note = F.when(when, F.lit(v)) if note is None else note.when(when, F.lit(v))
    f = F.concat(F.lit("exports/notes_"), F.lower("o_orderstatus"), F.lit(".csv"))
    lines = RN.render_records(o.withColumn("note", note), f, "o_orderkey", ["o_orderkey", "note", "o_orderpriority"])
    end = lines.where("file = 'exports/notes_p.csv'").groupBy("file").agg(F.max("line_no").alias("m"))
    tail = end.select("file", "m", F.posexplode(F.array(*[F.lit(x) for x in _OPEN_LINES])).alias("i", "value"))
    return lines.unionByName(tail.select("file", (F.col("m") + 1 + F.col("i")).alias("line_no"), "value"))


@query("scan_quoted_records", f"""SELECT {_NOTE_FILE} AS source_file, CAST(o_orderkey AS DOUBLE) AS o_orderkey, {_NOTE_SQL} AS note, o_orderpriority FROM orders""")
def q_scan_quoted(spark, sf):
    (t,) = SC.ingest(note_lines(spark, sf)).values()
    return t


@query("scan_quoted_rejects", f"""WITH f AS (SELECT {_NOTE_FILE} AS file, (o_orderkey + 1) * 16 + CASE o_orderkey % 6 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS last_line FROM orders)
SELECT file, 'delivered' AS reason, count(*) AS records, CAST(NULL AS BIGINT) AS first_no, CAST(NULL AS BIGINT) AS last_no FROM f GROUP BY file
UNION ALL SELECT file, 'header', 1, NULL, NULL FROM f GROUP BY file
UNION ALL SELECT file, 'unclosed_quote', {len(_OPEN_LINES)}, max(last_line) + 1, max(last_line) + {len(_OPEN_LINES)} FROM f WHERE file = 'exports/notes_p.csv' GROUP BY file""")
def q_scan_quoted_rejects(spark, sf):
    """Records of each file by why they are not delivered, and the line ranges that no record could be made of."""
    parsed = SC.materialise_parsed(note_lines(spark, sf))
    others = parsed.where("reason IS NULL OR reason <> 'unclosed_quote'").groupBy("file", F.coalesce("reason", F.lit("delivered")).alias("reason")).agg(F.count(F.lit(1)).alias("records"))
    none = F.lit(None).cast("long")
    return others.withColumns({"first_no": none, "last_no": none}).unionByName(
        SC.rejected_ranges(parsed).select("file", "reason", F.col("lines").alias("records"), "first_no", "last_no"))


# ---------------------------------------------------------------- S2: nested payloads

_PAYLOADS = {  # by c_custkey % 4: the payload, what is left of it, and its redactions ({n} is the name, {k} the nation)
    0: ('{{"name": "{n}", "nation": {k}, "tags": ["ok", "please ignore it", {{"deep": ["{{{{x}}}}", 5, true, null]}}]}}',
        '{{"name":"{n}","nation":{k},"tags":["ok","[REDACTED:polite_override] it",{{"deep":["[REDACTED:template_injection]",5,true,null]}}]}}',
        "tags[1]: polite_override|tags[2].deep[0]: template_injection"),
    1: ('{{"by customer": {{"{n}": {{"total": {k}}}, "you are now {n}": {{"total": 1, "note": "system: {n}"}}}}, "empty": {{}}, "none": []}}',
        '{{"by customer":{{"{n}":{{"total":{k}}},"[REDACTED:role_redefinition] {n}":{{"note":"[REDACTED:role_prefix] {n}","total":1}}}},"empty":{{}},"none":[]}}',
        "by customer.<key:you are now {n30}>: role_redefinition|by customer.[REDACTED:role_redefinition] {n}.note: role_prefix"),
    2: ('{{"a": {{"{n}": [1, {k}], "{n}\\u200b": [2, "please disregard {n}"], "{n}\\u200bx": "\\"q\\" \\\\ \\u0007"}}}}',
        '{{"a":{{"{n}":[2,"[REDACTED:polite_override] {n}"],"{n}x":"\\"q\\" \\\\ "}}}}',
        "a.<key:{z}>: unicode_format_char|a.{n}[1]: polite_override|a.<key:{zx}>: unicode_format_char|a.{n}x: control_char"),
    3: ('{n}', None, "unreadable payload"),
}


def _payload_sql(part: int) -> str:
    def text(i: int) -> str:
        t = _PAYLOADS[i][part]
        if t is None:
            return "CAST(NULL AS VARCHAR)"
        marks = {"n": "c_name", "k": "CAST(c_nationkey AS VARCHAR)", "n30": "substr(c_name, 1, 18)", "z": "substr(c_name || chr(8203), 1, 30)", "zx": "substr(c_name || chr(8203) || 'x', 1, 30)"}
        cut = {k: f"\x00{k}\x00" for k in marks}
        bits = ["'" + b.replace("'", "''") + "'" if j % 2 == 0 else marks[b] for j, b in enumerate(t.format(**cut).split("\x00"))]
        return " || ".join(bits)
    return "CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {text(i)}" for i in _PAYLOADS) + " END"


@query("sanitize_payloads", f"SELECT c_custkey, {_payload_sql(1)} AS clean_json, {_payload_sql(2)} AS redactions FROM customer")
def q_sanitize_payloads(spark, sf):
    """Payloads of three levels with lists, hostile names and texts, twin names, escapes, and one in four that is no JSON."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    made = None
    for i, (raw, _, _) in _PAYLOADS.items():
        bits = raw.format(n="\0n\0", k="\0k\0").split("\0")
        text = F.concat(*[F.lit(b) if j % 2 == 0 else {"n": F.col("c_name"), "k": F.col("c_nationkey").cast("string")}[b] for j, b in enumerate(bits)])
        made = F.when(F.col("c_custkey") % 4 == i, text) if made is None else made.when(F.col("c_custkey") % 4 == i, text)
    clean = PL.clean_payloads(c.select("c_custkey", made.alias("json")), "json")
    return clean.select("c_custkey", "clean_json", F.array_join("redactions", "|").alias("redactions"))


# ---------------------------------------------------------------- D1-D9: text, nulls, times of day, with messages

_AS_OF = "1998-06-30"
_TEXT_DATES = ("day_text", "gaps", "few_gaps", "words", "nothing", "stamped", "l_receiptdate")
_DATES_SQL = f"""WITH f AS (SELECT c_mktsegment AS client, strftime(o_orderdate, '%Y-%m') AS period, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT client, period, 'day_text' AS column_name, 0 AS cand_ord, false AS typed, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS t, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS d FROM f
UNION ALL SELECT client, period, 'gaps', 1, false, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END FROM f
UNION ALL SELECT client, period, 'few_gaps', 2, true, NULL, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate END FROM f
UNION ALL SELECT client, period, 'words', 3, false, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'word' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END FROM f
UNION ALL SELECT client, period, 'nothing', 4, true, NULL, NULL FROM f
UNION ALL SELECT client, period, 'stamped', 5, true, NULL, o_orderdate + INTERVAL 40 DAY + to_seconds(o_orderkey % 80000) FROM f),
s AS (SELECT client, period, column_name, cand_ord, typed, count(*) AS rows, count(d) AS n, count(DISTINCT d) AS dist, min(t) AS example, min(d) AS lo, max(d) AS hi,
  count(*) FILTER (WHERE d > TIMESTAMP '{_AS_OF}' + INTERVAL 3 DAY) AS future,
  count(*) FILTER (WHERE d >= CAST(period || '-01' AS TIMESTAMP) AND d <= CAST(last_day(CAST(period || '-01' AS DATE)) AS TIMESTAMP)) AS inside FROM v GROUP BY ALL),
r AS (SELECT *, 1.0 - n / greatest(rows, 1) AS null_rate, NOT typed AND n / greatest(rows, 1) < 0.5 AS no_date FROM s),
m AS (SELECT client, period, column_name, cand_ord, code, severity, metric, message, detail, CAST(CAST(lo AS DATE) AS VARCHAR) AS min_date, CAST(CAST(hi AS DATE) AS VARCHAR) AS max_date FROM r, LATERAL (SELECT * FROM (VALUES
  (CASE WHEN no_date THEN 'NOT_A_DATE' END, 'block', CAST(n / greatest(rows, 1) AS DOUBLE), '''' || column_name || ''' is string — fewer than 50% of values parse as dates', 'Sample values: [' || COALESCE('''' || example || '''', '') || ']'),
  (CASE WHEN NOT no_date AND NOT typed THEN 'DATE_NOT_PARSED' END, 'warn', n / greatest(rows, 1), '''' || column_name || ''' is string, coerced to datetime — confirm ingestion type detection', ''),
  (CASE WHEN NOT no_date AND null_rate > 0.05 THEN 'HIGH_NULL_RATE' END, 'block', null_rate, printf('%.1f', null_rate * 100) || '% of dates are null — YTD and MoM will be incorrect', CAST(floor(null_rate * rows) AS BIGINT) || ' null rows out of ' || rows),
  (CASE WHEN NOT no_date AND n = 0 THEN 'ALL_NULL' END, 'block', NULL, 'All date values are null', ''),
  (CASE WHEN NOT no_date AND n > 0 AND future > 0 THEN 'FUTURE_DATES' END, 'warn', future, future || ' rows have dates more than 3 days in the future', 'Max date: ' || CAST(hi AS DATE) || ' — possible data entry error or wrong column'),
  (CASE WHEN NOT no_date AND n > 0 AND inside = 0 THEN 'PERIOD_MISMATCH' END, 'block', inside, 'No dates fall within expected period ' || period, 'Data spans ' || CAST(lo AS DATE) || ' → ' || CAST(hi AS DATE) || '. Wrong file?'),
  (CASE WHEN NOT no_date AND n > 0 AND inside > 0 AND inside < rows * 0.8 THEN 'PARTIAL_PERIOD' END, 'warn', inside, 'Only ' || inside || '/' || rows || ' rows fall within ' || period, 'Partial month? Check if data is complete.'),
  (CASE WHEN NOT no_date AND n > 0 AND rows = dist + CASE WHEN n < rows THEN 1 ELSE 0 END THEN 'ALL_DATES_UNIQUE' END, 'warn', NULL,
   'Every date is unique — this may be a summary row (one per day) rather than a transaction table', 'PREVIOUSMONTH / DATEADD work correctly, but verify grain matches your DAX.'))
  x(code, severity, metric, message, detail) WHERE code IS NOT NULL))
"""


def text_dates(spark, sf) -> DataFrame:
    """Orders by client and month, with date columns as exports have them: text, with gaps, hardly any dates, none at all, with times of day."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("client")), "o_custkey")
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    iso = F.date_format(d, "yyyy-MM-dd")
    return o.select("client", F.date_format(d, "yyyy-MM").alias("period"), F.when(k % 50 == 0, "n/a").otherwise(F.date_format(d, "dd.MM.yyyy")).alias("day_text"),
                    F.when(k % 10 != 0, iso).alias("gaps"), F.when(k % 40 != 0, d).alias("few_gaps"), F.when(k % 3 == 0, iso).otherwise("word").alias("words"),
                    F.lit(None).cast("timestamp").alias("nothing"), (F.timestamp_seconds(F.unix_timestamp(d.cast("timestamp")) + 40 * 86400 + k % 80000)).alias("stamped"))


@query("date_validate_text", _DATES_SQL + """SELECT * FROM m UNION ALL SELECT DISTINCT client, period, 'l_receiptdate', 6, 'COLUMN_NOT_FOUND', 'block', CAST(NULL AS DOUBLE),
  'Date column ''l_receiptdate'' does not exist in the DataFrame', '', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM f""")
def q_date_validate_text(spark, sf):
    stats = D.date_stats(text_dates(spark, sf), _TEXT_DATES, _AS_OF)
    found = D.date_messages(D.date_issues(stats), stats)
    return found.withColumns({c: F.col(c).cast("string") for c in ("min_date", "max_date")})


# ---------------------------------------------------------------- C1 C8 A13: fingerprints that merge

_SKETCHED = ["l_orderkey", "l_shipdate", "revenue", "quantity", "l_returnflag", "r_name"]
_NEW_FROM = "1998-01"


def _sketched(spark, sf) -> DataFrame:
    return CA._fact(spark, sf).select("client", "period", *_SKETCHED).withColumn("r_name", F.when(F.col("l_orderkey") % 8 != 0, F.col("r_name")))


@query("fingerprint_merge", Q.base() + " UNION ALL ".join(f"""SELECT client, '{c}' AS column_name, count(*) AS row_count, count(*) - count({v}) AS null_count,
  least(count(DISTINCT {v}), {SK.KEPT}) AS hashes, CASE WHEN count(DISTINCT {v}) < {SK.KEPT} THEN count(DISTINCT {v}) END AS distinct_values, true AS same_as_whole FROM fact GROUP BY client"""
    for c, v in [(c, c if c != "r_name" else "CASE WHEN l_orderkey % 8 <> 0 THEN r_name END") for c in _SKETCHED]))
def q_fingerprint_merge(spark, sf):
    """Each client's stored fingerprint, merged with that of the new months alone and stored again, against one over all rows."""
    f = _sketched(spark, sf)
    old, new = f.where(F.col("period") < _NEW_FROM).drop("period"), f.where(F.col("period") >= _NEW_FROM).drop("period")
    first, second = _scratch(spark, "sketches"), _scratch(spark, "sketches")
    before = SK.sketch(old, "fact", "client")
    SI.write_fingerprint(before, first)
    stored = SI.load_fingerprint(spark, first, before.schema)
    SI.write_fingerprint(SK.merge(stored.unionByName(SK.sketch(new, "fact", "client"))), second)
    now = SI.load_fingerprint(spark, second, before.schema)
    whole = SK.sketch(f.drop("period"), "fact", "client").select("client", "column_name", F.struct("row_count", "null_count", "hashes", "samples").alias("w"))
    j = now.join(whole, ["client", "column_name"], "full_outer")
    return j.select("client", "column_name", "row_count", "null_count", F.size("hashes").cast("long").alias("hashes"),
                    F.when(F.size("hashes") < SK.KEPT, SK.cardinality(F.col("hashes"))).alias("distinct_values"),
                    F.struct("row_count", "null_count", "hashes", "samples").eqNullSafe(F.col("w")).alias("same_as_whole"))


@query("fingerprint_drift", Q.base() + """SELECT 'fact' AS table_name, client, column_name, code, severity FROM (SELECT DISTINCT client FROM fact),
  (VALUES ('quantity', 'TYPE_REGRESSION', 'block'), ('l_shipdate', 'DATE_REGRESSION', 'block'), ('r_name', 'COLUMN_MISSING', 'block'), ('l_comment', 'COLUMN_ADDED', 'warn')) e(column_name, code, severity)
UNION ALL SELECT 'fact', client, 'l_returnflag', 'CARDINALITY_EXPLOSION', 'warn' FROM fact GROUP BY client
  HAVING count(DISTINCT CASE WHEN period >= '1998-01' THEN l_returnflag || l_orderkey % 60 END) > 5 * count(DISTINCT CASE WHEN period < '1998-01' THEN l_returnflag END)
     AND count(DISTINCT CASE WHEN period < '1998-01' THEN l_returnflag END) > 0""")
def q_fingerprint_drift(spark, sf):
    """Drift of the new months, which alone are read, against the stored fingerprint of the others."""
    f = _sketched(spark, sf)
    old = SK.sketch(f.where(F.col("period") < _NEW_FROM).drop("period"), "fact", "client")
    new = f.where(F.col("period") >= _NEW_FROM).withColumns({
        "quantity": F.col("quantity").cast("string"), "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "l_returnflag": F.concat("l_returnflag", (F.col("l_orderkey") % 60).cast("string")), "l_comment": F.lit("new")}).drop("period", "r_name")
    path = _scratch(spark, "sketches")
    SI.write_fingerprint(old, path)
    stored = SI.load_fingerprint(spark, path, old.schema)
    return P.drift(SK.as_profile(stored), SK.as_profile(SK.sketch(new, "fact", "client")), ("table_name", "client")).select("table_name", "client", "column_name", "code", "severity")


# ---------------------------------------------------------------- H11 A16 M1: golden values under filters

_FILTERS = [("All data, no filter", "", "TRUE"), ("All sales", "ALL(sales)", "TRUE"),
            ("Europe, ten and more", 'sales[r_name] = "EUROPE" && sales[quantity] >= 10', "r_name = 'EUROPE' AND quantity >= 10"),
            ("Returned or accepted", "sales[l_returnflag] IN {\"A\", \"R\"}, NOT ('sales'[quantity] < 5 || [quantity] > 45)", "l_returnflag IN ('A', 'R') AND NOT (quantity < 5 OR quantity > 45)"),
            ("Early shipments", "sales[l_shipdate] < DATE(1995, 6, 17)", "l_shipdate < TIMESTAMP '1995-06-17'"),
            ("Broken", "sales[r_name] = ", None), ("Unknown column", "sales[colour] = 1", None)]
_FILTER_ERRORS = {"Broken": "Filter cannot be read: sales[r_name] = ", "Unknown column": "Filter cannot be read: no column colour"}


def _golden_sql() -> str:
    rows = []
    for context, text, sql in _FILTERS:
        t = text.replace("'", "''")
        for name, m in (("total_revenue", "revenue"), ("total_quantity", "quantity")):
            actual = f"CAST(sum({m}) FILTER (WHERE {sql}) AS DOUBLE)" if sql else "CAST(NULL AS DOUBLE)"
            rows.append(f"SELECT client, period, '{name}' AS measure_name, '{context}' AS filter_context, '{t}' AS dax_filter, CAST(sum({m}) AS DOUBLE) AS expected, {actual} AS actual FROM fact GROUP BY client, period")
    error = "CASE " + " ".join(f"WHEN filter_context = '{c}' THEN '{e}'" for c, e in _FILTER_ERRORS.items()) + \
            " WHEN actual IS NULL THEN 'Measure not found in actuals — not deployed or name mismatch' ELSE '' END"
    return "a AS (" + " UNION ALL ".join(rows) + f"), c AS (SELECT *, abs(actual - expected) / abs(expected) * 100 AS dev, {error} AS error FROM a)"


@query("golden_filters", Q.base(_golden_sql()) + "SELECT client, period, measure_name, dax_filter, filter_context, expected, actual, COALESCE(dev <= 0.1, false) AS passed, dev AS deviation_pct, error FROM c")
def q_golden_filters(spark, sf):
    """Every report's totals as golden values under seven filters, two of which can't be read; all filters are one pass over the fact."""
    f = CA._fact(spark, sf)
    measures = {"total_revenue": (F.sum, "revenue"), "total_quantity": (F.sum, "quantity")}
    suite = F.array(*[F.struct(F.lit(c).alias("filter_context"), F.lit(t).alias("dax_filter")) for c, t, _ in _FILTERS])
    totals = f.groupBy("client", "period").agg(*[kind(c).cast("double").alias(n) for n, (kind, c) in measures.items()])
    values = totals.select("client", "period", F.inline(suite), *measures).select(
        "client", "period", "filter_context", "dax_filter", F.inline(F.array(*[F.struct(F.lit(n).alias("measure_name"), F.col(n).alias("expected_value")) for n in measures])))
    values = values.withColumns({"tolerance_pct": F.lit(0.1), "tolerance_abs": F.lit(None).cast("double")}).checkpoint()
    signoff = values.select("client").distinct().withColumns({"seeded_by": F.lit("a"), "verified_by": F.lit("b"), "client_signoff_email": F.lit("c@d.example")})
    return GF.compare_filtered(values, GF.actuals(f, values, measures), signoff)


# ---------------------------------------------------------------- K5 K6: decimals from the exact binary value

@query("fixed_decimals", """SELECT o_orderkey, printf('%+.1f', x) AS one, printf('%.2f', x) AS two, printf('%.0f', x) AS none FROM (SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 401 - 200) / 100 WHEN 1 THEN (o_orderkey % 81 - 40) / 1000 WHEN 2 THEN (o_orderkey % 33 - 16) / 8 WHEN 3 THEN o_totalprice / 7 ELSE -o_totalprice END AS x FROM orders)""")
def q_fixed_decimals(spark, sf):
    """Hundredths such as -0.04 and 0.35, thousandths, exact halves, and large values, with no, one and two decimals."""
    k = F.col("o_orderkey")
    x = (F.when(k % 5 == 0, (k % 401 - 200) / 100).when(k % 5 == 1, (k % 81 - 40) / 1000).when(k % 5 == 2, (k % 33 - 16) / 8).when(k % 5 == 3, F.col("o_totalprice") / 7).otherwise(-F.col("o_totalprice")))
    o = table(spark, sf, "orders").select("o_orderkey", x.alias("x"))
    return o.select("o_orderkey", TX.fixed(F.col("x"), 1, plus=True).alias("one"), TX.fixed(F.col("x"), 2).alias("two"), TX.fixed(F.col("x"), 0).alias("none"))


# ---------------------------------------------------------------- Q14: the text of round-number flags

@query("round_number_messages", Q.base() + """SELECT client, period, kpi || ':' || label AS subject, kpi || ' ' || label || ' is suspiciously round (' || CAST(v AS VARCHAR) || ')' AS message,
  'Check: percentage column misread as monetary?' AS detail FROM (SELECT client, period, kpi, 'current' AS label, CASE kpi_ord % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 100.0 WHEN 2 THEN -1000.0 ELSE 10000.04 END AS v FROM delta
  UNION ALL SELECT client, period, kpi, 'previous', 99.96 FROM delta WHERE kpi_ord % 2 = 0)""")
def q_round_messages(spark, sf):
    pair, d, c, thr = CA.gate_inputs(spark, sf)
    o = F.col("kpi_ord") % 4
    value = F.when(o == 0, 0.0).when(o == 1, 100.0).when(o == 2, -1000.0).otherwise(10000.04)
    planted = d.withColumns({"current": value, "previous": F.when(F.col("kpi_ord") % 2 == 0, 99.96).otherwise(123.4)})
    return MS.with_messages(G.round_number_flags(planted), pair, planted, c, thr).select("client", "period", "subject", "message", "detail")


# ---------------------------------------------------------------- A18 A19: what payloads hold

@query("held_packet_values", CA._FULL + f""", flags AS ({CA._ALL_FLAGS}), held AS (SELECT client, period FROM flags GROUP BY client, period HAVING count(*) FILTER (WHERE severity = 'block') > 0)
SELECT d.client, d.period, d.kpi, d.current, d.previous, d.abs, d.pct, d.period || ' vs ' || d.prev_period AS span, c.headline, c.executive_summary, CAST(c.n_claims AS INTEGER) AS n_claims
FROM delta d JOIN held USING (client, period) JOIN comm c ON c.client = d.client AND c.period = d.period""")
def q_held_values(spark, sf):
    schema = "period STRING, commentary STRUCT<headline: STRING, executive_summary: STRING, root_cause_claims: ARRAY<STRUCT<claim: STRING>>>, kpi_deltas MAP<STRING, STRUCT<current: DOUBLE, previous: DOUBLE, abs: DOUBLE, pct: DOUBLE>>"
    r = CA.q_held_packets(spark, sf).select("client", "period", F.from_json("json", schema).alias("j"))
    return r.select("client", "period", F.explode("j.kpi_deltas").alias("kpi", "v"), "j").select(
        "client", "period", "kpi", "v.*", F.col("j.period").alias("span"), "j.commentary.headline", "j.commentary.executive_summary", F.size("j.commentary.root_cause_claims").alias("n_claims"))


@query("prompt_context_notes", Q.base(CA._PAIR_CTE) + """SELECT d.client, d.period, d.period || ' vs ' || any_value(d.prev_period) AS span,
  (SELECT string_agg(kpi, ',' ORDER BY r) FROM (SELECT kpi, row_number() OVER (ORDER BY abs(pct) DESC, kpi_ord) AS r FROM delta x WHERE x.client = d.client AND x.period = d.period) WHERE r <= 5) AS movers,
  p.period_days - p.prev_period_days AS difference_days,
  CASE WHEN abs(p.period_days - p.prev_period_days) >= 2 THEN 'Period length differs by ' || abs(p.period_days - p.prev_period_days) || ' day(s). Attribute up to '
    || printf('%.1f', abs((p.period_days - p.prev_period_days) / greatest(p.prev_period_days, 1)) * 100) || '% of any revenue delta to period length, not business change.' ELSE 'Period lengths match.' END AS note
FROM delta d JOIN pair p ON p.client = d.client AND p.period = d.period GROUP BY d.client, d.period, p.period_days, p.prev_period_days""")
def q_prompt_notes(spark, sf):
    schema = "period STRING, top_movers ARRAY<STRUCT<kpi: STRING>>, period_days STRUCT<difference_days: BIGINT, analyst_note: STRING>"
    r = CA.q_prompt_context(spark, sf).select("client", "period", F.from_json("json", schema).alias("j"))
    return r.select("client", "period", F.col("j.period").alias("span"), F.array_join(F.col("j.top_movers")["kpi"], ",").alias("movers"),
                    F.col("j.period_days.difference_days").alias("difference_days"), F.col("j.period_days.analyst_note").alias("note"))


# ---------------------------------------------------------------- A14: push batches of exactly 10,000 rows

@query("push_batches", f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem),
b AS (SELECT *, i // {SI.PUSH_BATCH_ROWS} AS batch, i % {SI.PUSH_BATCH_ROWS} AS place FROM n)
SELECT batch // {SI.PUSH_HOUR_ROWS // SI.PUSH_BATCH_ROWS} AS hour, batch, count(*) AS rows, min_by(l_orderkey * 100 + l_linenumber, place) AS first_key, max_by(l_orderkey * 100 + l_linenumber, place) AS last_key,
  max_by(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S'), place) AS last_shipdate FROM b GROUP BY batch""")
def q_push_batches(spark, sf):
    """The batches as they were written: one file each, in key order, however the rows were partitioned."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    path = _scratch(spark, "push")
    SI.write_push_plan(SI.push_plan(li, ["l_orderkey", "l_linenumber"]), path)
    back = spark.read.schema("l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_shipdate STRING, place INT, hour BIGINT, batch BIGINT").json(path)
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return back.groupBy("hour", "batch").agg(F.count(F.lit(1)).alias("rows"), F.min_by(key, "place").alias("first_key"), F.max_by(key, "place").alias("last_key"), F.max_by("l_shipdate", "place").alias("last_shipdate"))


# ---------------------------------------------------------------- S4: keyed pseudonyms and their mapping

_KEY = b"an example key, 16 bytes or more"


def _hmac_sql(text: str) -> str:
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"'p_' || substr(sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({text})))), 1, 32)"


@query("pseudonym_mapping", f"""SELECT c_custkey, {_hmac_sql('c_name')} AS pseudonym, CASE WHEN c_custkey % 3 <> 0 THEN 'run 1' ELSE 'run 2' END AS first_run, c_name AS restored, 0 AS collisions FROM customer""")
def q_pseudonym_mapping(spark, sf):
    """Two runs, the second over all names: the mapping keeps the first run's rows, and leads every pseudonym back to its name."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    path = _scratch(spark, "pseudonyms")
    PS.append_mapping(c.where("c_custkey % 3 <> 0"), path, _KEY, "run 1", "c_name")
    mapping = PS.append_mapping(c, path, _KEY, "run 2", "c_name")
    hidden = c.select("c_custkey", PS.keyed_pseudonym(F.col("c_name"), _KEY).alias("pseudonym"))
    back = PS.restore(hidden, mapping, "pseudonym", "restored").join(mapping.select("pseudonym", "first_run"), "pseudonym")
    bad = PS.collisions(mapping).agg(F.count(F.lit(1)).alias("collisions"))
    return back.select("c_custkey", "pseudonym", "first_run", "restored", bad.scalar().alias("collisions"))


# ---------------------------------------------------------------- A10 J5: every line of a damaged log

@query("audit_log_lines", CA._LEDGER + """SELECT status, reason, count(*) AS lines, count(DISTINCT id) AS reports FROM (
  SELECT 'read' AS status, CAST(NULL AS VARCHAR) AS reason, report_id AS id FROM audit
  UNION ALL SELECT 'repeated', NULL, report_id FROM audit WHERE seq = 1
  UNION ALL SELECT 'rejected', 'malformed', NULL FROM audit WHERE seq = 2
  UNION ALL SELECT 'rejected', 'no_key', NULL FROM audit WHERE seq = 3
  UNION ALL SELECT 'rejected', 'blank', NULL FROM audit WHERE seq = 3) GROUP BY status, reason""")
def q_audit_log_lines(spark, sf):
    """A log with damage planted: lines delivered twice, cut off, without a report id, and blank. All lines are accounted for."""
    audit = CA.ledger_inputs(spark, sf)[0]
    path = _scratch(spark, "audit")
    AU.write_log(audit, path)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("seq", F.get_json_object("value", "$.seq").cast("int"))
    cut = F.substring("value", F.lit(1), F.length("value") - 9)
    nameless = F.regexp_replace("value", '"report_id":', '"other_id":')
    bad = lines.select(F.explode(F.array_compact(F.array(F.when(F.col("seq") == 1, F.col("value")), F.when(F.col("seq") == 2, cut), F.when(F.col("seq") == 3, nameless), F.when(F.col("seq") == 3, "")))).alias("value"))
    bad.checkpoint().write.mode("append").text(path)
    return AU.log_lines(spark, path).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("record.report_id").alias("reports"))
