"""DuckDB text of the shared building blocks, so each oracle reads like the Spark plan."""

from __future__ import annotations

from ..sources.testdata import FACT_SQL, MEASURES

KINDS = ("total", "avg", "max")


def agg_cte(date_col: str = "o_orderdate") -> str:
    parts = ["count(*) AS row_count"]
    for m in MEASURES:
        parts += [f"sum({m}) AS s_{m}", f"count({m}) AS c_{m}", f"max({m}) AS m_{m}"]
    parts += [f"min({date_col}) AS min_ts", f"max({date_col}) AS max_ts"]
    return f"agg AS (SELECT client, period, {', '.join(parts)} FROM fact GROUP BY client, period)"


def kpi_cte() -> str:
    sel = []
    for i, m in enumerate(MEASURES):
        vals = (f"CAST(s_{m} AS DOUBLE)", f"CAST(s_{m} AS DOUBLE) / c_{m}", f"CAST(m_{m} AS DOUBLE)")
        for j, (k, v) in enumerate(zip(KINDS, vals)):
            sel.append(f"SELECT client, period, '{k}_{m}' AS kpi, {i * 3 + j + 1} AS kpi_ord, {v} AS value "
                       f"FROM agg WHERE c_{m} > 0")
    return "kpi AS (" + " UNION ALL ".join(sel) + ")"


SNAP_CTE = """snap AS (SELECT client, period, row_count,
  COALESCE((epoch_us(max_ts) - epoch_us(min_ts)) // 86400000000 + 1, 0) AS period_days FROM agg)"""


def prev_expr(col: str = "period", months: int = 1) -> str:
    return f"strftime(TRY_CAST({col} || '-01' AS DATE) - INTERVAL {months} MONTH, '%Y-%m')"


def delta_cte(months: int = 1, name: str = "delta") -> str:
    return f"""{name} AS (
  SELECT c.client, c.period, p.period AS prev_period, c.kpi, c.kpi_ord,
         c.value AS current, p.value AS previous, c.value - p.value AS abs,
         CASE WHEN p.value = 0 THEN 0.0 ELSE (c.value - p.value) / p.value * 100 END AS pct
  FROM kpi c JOIN kpi p ON p.client = c.client AND p.kpi = c.kpi AND p.period = {prev_expr('c.period', months)})"""


def base(*extra: str, date_col: str = "o_orderdate") -> str:
    """WITH fact, agg, kpi, snap, delta [, extra...]"""
    ctes = [f"fact AS ({FACT_SQL})", agg_cte(date_col), kpi_cte(), SNAP_CTE, delta_cte(), *extra]
    return "WITH " + ",\n".join(ctes) + "\n"


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
DATETIME_TYPES = ("date", "timestamp", "timestamp_ntz")


def profile_sql(specs) -> str:
    """Per-column profile rows for ``specs = [(table_name, from_sql, [(column, dtype), ...]), ...]``."""
    sel = []
    for name, src, cols in specs:
        for i, (c, t) in enumerate(cols):
            num = "true" if (t in NUMERIC_TYPES or t.startswith("decimal")) else "false"
            dt = "true" if t in DATETIME_TYPES else "false"
            v = f"CAST({c} AS VARCHAR)"
            sel.append(f"""SELECT '{name}' AS table_name, '{c}' AS column_name, {i} AS ord, '{t}' AS dtype,
  {num} AS is_numeric, {dt} AS is_datetime, count(*) AS row_count, count(DISTINCT {v}) AS cardinality,
  count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) AS null_rate,
  COALESCE((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {v} AS v FROM {src} WHERE {c} IS NOT NULL
            ORDER BY v LIMIT 5)), '') AS samples FROM {src}""")
    return "\nUNION ALL\n".join(sel)


ROLES_SQL = """SELECT *,
  CASE WHEN regexp_matches(column_name, '(?i)(unnamed|empty|blank|filler)') THEN 'ignore'
       WHEN is_datetime THEN 'date'
       WHEN regexp_matches(column_name, '(?i)(^id$|_id$|^code$|_code$|_no$|^no_|_key$|^key_)') THEN 'id_key'
       WHEN is_numeric AND cardinality / greatest(row_count, 1) > 0.05 THEN 'numeric_measure'
       ELSE 'text_dimension' END AS role,
  CASE WHEN regexp_matches(column_name, '(?i)(unnamed|empty|blank|filler)') THEN dtype
       WHEN is_datetime THEN 'datetime'
       WHEN regexp_matches(column_name, '(?i)(^id$|_id$|^code$|_code$|_no$|^no_|_key$|^key_)') THEN dtype
       WHEN is_numeric AND cardinality / greatest(row_count, 1) > 0.05 THEN 'numeric'
       WHEN is_numeric THEN 'numeric_cat' ELSE 'text' END AS role_dtype
FROM prof"""
