"""Golden values under a filter: each suite value names the rows that its measure is taken over.

A filter text is rewritten, sign by sign, to an expression of the engine's own SQL, which reads it; nothing but columns of the
fact, literals, comparisons, ``IN``, ``&&``, ``||``, ``NOT``, brackets and ``ALL`` is let through. All distinct filters of all suites are conditional
aggregates of one pass over the fact. A filter that can't be read is a failed row that says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .golden import compare
from .joins import broadcast_if_small

#: Distinct filter texts of all suites: analysts write them, and each is a column of the aggregate.
MOST_FILTERS = 1000
UNREADABLE = "Filter cannot be read: "
_SIGNS = re.compile(r"""\s+|(?P<all>ALL\s*\(\s*(?:'[^']*'|\w+)(?:\[[^\]]*\])?\s*\))|(?P<blank>=\s*BLANK\(\s*\))|(?P<bool>(?:TRUE|FALSE)\(\s*\))
    |(?P<date>DATE\(\s*\d{1,4}\s*,\s*\d{1,2}\s*,\s*\d{1,2}\s*\))|(?P<text>"(?:[^"]|"")*")|(?P<column>(?:'[^']*'|\w+)?\[[^\]]+\])|(?P<number>\d+(?:\.\d+)?)
    |(?P<word>(?:IN|NOT)\b)|(?P<sign>&&|\|\||<>|<=|>=|[<>=(){},-])""", re.X | re.I)


class UnreadableFilter(ValueError):
    """A filter text with a sign, a column or a form that has no meaning here."""


def to_sql(text: str, columns: list[str]) -> str:
    """The filter as a boolean expression of Spark SQL. '' lets all rows through, and so does ``ALL(...)``; filters in a row, divided by commas, hold together."""
    known = {c.lower(): c for c in columns}
    out, at, depth = [], 0, 0
    while at < len(text):
        m = _SIGNS.match(text, at)
        if not m:
            raise UnreadableFilter(f"{UNREADABLE}{text[at:at + 20]}")
        at, kind, s = m.end(), m.lastgroup, m.group().strip()
        if kind == "column":
            name = s[s.index("[") + 1:-1].lower()
            if name not in known:
                raise UnreadableFilter(f"{UNREADABLE}no column {name}")
            out.append(f"`{known[name]}`")
        elif kind == "text":
            out.append("'" + s[1:-1].replace('""', '"').replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif kind == "date":
            y, mo, d = map(int, re.findall(r"\d+", s))
            out.append(f"TIMESTAMP_NTZ '{y:04d}-{mo:02d}-{d:02d} 00:00:00'")
        elif kind == "sign":
            depth += (s == "{") - (s == "}")
            out.append({"&&": "AND", "||": "OR", "{": "(", "}": ")"}.get(s, ") AND (" if s == "," and not depth else s))
        elif kind:
            out.append({"all": "TRUE", "blank": "IS NULL", "bool": s.rstrip("() ")}.get(kind, s))
    return "(" + (" ".join(out) or "TRUE") + ")"


def _predicate(fact: DataFrame, text: str) -> tuple[Column | None, str]:
    """The filter as a column, or why it is none."""
    try:
        wanted = F.expr(to_sql(text, fact.columns))
        if fact.select(wanted.alias("p")).schema["p"].dataType.simpleString() != "boolean":
            return None, f"{UNREADABLE}{text[:20]}"
        return wanted, ""
    except UnreadableFilter as why:
        return None, str(why)
    except (ParseException, AnalysisException):
        return None, f"{UNREADABLE}{text[:20]}"


def actuals(fact: DataFrame, values: DataFrame, measures: dict[str, tuple[Callable[[Column], Column], str]]) -> DataFrame:
    """actual(client, period, measure_name, dax_filter, value, filter_error) for every filter of ``values`` and every measure, from one pass.

    ``measures`` gives an aggregate and a column by name, as ``{"total_revenue": (F.sum, "revenue")}``; under a filter it sees the filter's
    rows. A measure over no rows is null.
    """
    spark = fact.sparkSession
    ensure_checkpoint_dir(spark)
    texts = [r[0] for r in values.select(F.coalesce("dax_filter", F.lit(""))).distinct().orderBy(F.lit(1)).limit(MOST_FILTERS + 1).collect()]  # what analysts wrote, bounded
    if len(texts) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} different filters")
    read = {t: _predicate(fact, t) for t in texts}
    flags = fact
    for i, t in enumerate(texts):
        if read[t][0] is not None:
            flags = flags.withColumn(f"_f{i}", read[t][0])
    aggs, rows = [], []
    for i, t in enumerate(texts):
        for name, (kind, c) in measures.items():
            wanted, why = read[t]
            alias = f"_v{len(rows)}"
            if wanted is not None:
                aggs.append(kind(F.when(F.col(f"_f{i}"), F.col(c))).cast("double").alias(alias))
            rows.append(F.struct(F.lit(name).alias("measure_name"), F.lit(t).alias("dax_filter"), (F.col(alias) if wanted is not None else F.lit(None).cast("double")).alias("value"), F.lit(why).alias("filter_error")))
    if not rows:
        return spark.createDataFrame([], "client string, period string, measure_name string, dax_filter string, value double, filter_error string")
    return flags.groupBy("client", "period").agg(F.count(F.lit(1)).alias("_rows"), *aggs).select("client", "period", F.inline(F.array(*rows)))


def compare_filtered(values: DataFrame, found: DataFrame, signoff: DataFrame, allow_unsigned: bool = False) -> DataFrame:
    """golden_result as :func:`.golden.compare` gives it, with ``dax_filter`` and ``filter_context``: each value against the actual under its own filter."""
    marked = lambda df: df.withColumn("measure_name", F.to_json(F.struct("measure_name", F.coalesce("dax_filter", F.lit("")).alias("dax_filter"))))
    told = found.where("filter_error <> ''").select(F.col("dax_filter").alias("_text"), "filter_error").distinct()
    out = compare(marked(values), marked(found), signoff, allow_unsigned)
    name = F.from_json("measure_name", "measure_name STRING, dax_filter STRING")
    out = out.select("client", "period", name["measure_name"].alias("measure_name"), name["dax_filter"].alias("dax_filter"), "expected", "actual", "passed", "deviation_pct", "error")
    contexts = values.select("client", "period", "measure_name", F.coalesce("dax_filter", F.lit("")).alias("dax_filter"), "filter_context").distinct()
    out = out.join(broadcast_if_small(contexts), ["client", "period", "measure_name", "dax_filter"], "left")
    out = out.join(broadcast_if_small(told), F.col("dax_filter") == F.col("_text"), "left")
    unsigned = F.col("error") == "GOLDEN_SUITE_UNSIGNED"
    return out.withColumn("error", F.when(~unsigned, F.coalesce("filter_error", "error")).otherwise(F.col("error"))).drop("_text", "filter_error")
