"""Render tables as report exports (lines / grids), so the scans can be run over real data.

Banner lines, rule lines and a header are written per file; data lines keep
an ordering key so ``line_no`` needs no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_text(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, "yyyy-MM-dd")
    return F.col(c).cast("string")


def render_lines(df: DataFrame, file_col: Column, order_col: str, columns: Sequence[str], layout: str = "delimited",
                 sep: str = ";", banner: Sequence[str] = ("Report: export", "Created by: ledger"),
                 period_col: Column | None = None) -> DataFrame:
    """lines(file, line_no, value) of ``df`` written as one export per distinct ``file_col``."""
    cells = [F.coalesce(cell_text(df, c), F.lit("")) for c in columns]
    if layout == "pipe":
        value = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        header = "| " + " | ".join(columns) + " |"
        rule = "|" + "|".join("-" * (len(c) + 2) for c in columns) + "|"
    else:
        value = F.concat_ws(sep, *cells)
        header = sep.join(columns)
        rule = "-" * 20
    rows = df.select(file_col.alias("file"), (F.col(order_col).cast("long") + 100).alias("line_no"), value.alias("value"))
    files = df.select(file_col.alias("file"), *([period_col.alias("_p")] if period_col is not None else [])).distinct()
    head = [F.lit(b) for b in banner]
    if period_col is not None:
        head.append(F.concat(F.lit("Period: "), F.col("_p")))
    head += [F.lit(rule), F.lit(header)]
    if layout == "pipe":
        head.append(F.lit(rule))
    top = files.select("file", F.posexplode(F.array(*head)).alias("line_no", "value")) \
        .select("file", F.col("line_no").cast("long"), "value")
    return top.unionByName(rows)


def quoted(text: Column, sep: str) -> Column:
    """A cell's text, in quotes if it holds a separator, a quote or a line feed."""
    special = text.contains(sep) | text.contains('"') | text.contains("\n")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def render_records(df: DataFrame, file_col: Column, order_col: str, columns: Sequence[str], sep: str = ";", most_lines: int = 16) -> DataFrame:
    """lines(file, line_no, value) of ``df`` written as one export per distinct ``file_col``; a cell with line feeds takes several lines."""
    value = F.concat_ws(sep, *[quoted(F.coalesce(cell_text(df, c), F.lit("")), sep) for c in columns])
    rows = df.select(file_col.alias("file"), F.col(order_col).cast("long").alias("_at"), F.posexplode(F.split(value, "\n", -1)).alias("_i", "value"))
    rows = rows.select("file", ((F.col("_at") + 1) * most_lines + F.col("_i")).alias("line_no"), "value")
    top = df.select(file_col.alias("file")).distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.lit(sep.join(columns)).alias("value"))
    return top.unionByName(rows)


def render_grid(df: DataFrame, file_col: Column, sheet_col: Column, order_col: str, columns: Sequence[str],
                title: str = "Catalogue") -> DataFrame:
    """grid(file, sheet, row_no, cells): a title row, an empty row, the header, data, plus an empty column."""
    cells = F.array(F.lit(None).cast("string"), *[cell_text(df, c) for c in columns])
    rows = df.select(file_col.alias("file"), sheet_col.alias("sheet"),
                     (F.col(order_col).cast("long") + 10).alias("row_no"), cells.alias("cells"))
    sheets = df.select(file_col.alias("file"), sheet_col.alias("sheet")).distinct()
    n = len(columns) + 1
    title_row = F.array(F.lit(None).cast("string"), F.lit(title), *[F.lit(None).cast("string")] * (n - 2))
    empty = F.array(*[F.lit(None).cast("string")] * n)
    header = F.array(F.lit(None).cast("string"), *[F.lit(c) for c in columns])
    top = sheets.select("file", "sheet", F.posexplode(F.array(title_row, empty, header)).alias("row_no", "cells")) \
        .select("file", "sheet", F.col("row_no").cast("long"), "cells")
    return top.unionByName(rows)
