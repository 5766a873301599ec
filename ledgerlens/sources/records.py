"""Records of delimited exports whose quoted cells run over several lines.

A quote opens a cell only where the cell begins, and a doubled quote inside stands for one. Whether a line ends inside an open cell
depends on whether it began in one. So each line is a function of two states, and a run of lines is such a function too: a
constant, the identity or a swap. The state before a line is found without reading a file in one task: lines are sorted over all
tasks, each range sums up its lines (the last constant, and the swaps since), and the sums of a file's ranges, one row each, are
combined in order. A record begins where the state before the line is "outside". Only lines of records with several lines are then
brought together, and files without a line that leaves a cell open are not sorted at all.

A cell that is never closed would take the rest of its file, and a stray quote all lines up to the next one. Such records are not put together:
lines of a record without an end, or of more than ``LONGEST`` lines, are rejected one by one, with the range they are in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir

#: Lines of a record, at most.
LONGEST = 10_000
UNCLOSED, TOO_LONG = "unclosed_quote", "record_too_long"


def _escaped(sep: str) -> str:
    return "\t" if sep == "\t" else "\\" + sep


def ends_open(value: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it begins outside one, and if it begins inside one."""
    s = _escaped(sep)
    closed = rf'"(?:[^"]|"")*+"(?!")[^{s}]*+'
    cells = rf'(?:(?:{closed}|[^"{s}][^{s}]*+)?+{s})*+'
    begun = r'"(?:[^"]|"")*+$'
    quoted = value.contains('"')
    outside = quoted & value.rlike(f"(?s)^{cells}{begun}")
    inside = ~quoted | value.rlike(rf'(?s)^(?:[^"]|"")*+(?:"(?!")[^{s}]*+{s}{cells}{begun}|$)')
    return outside, inside


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the checkpoint folder, compressed, and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parity(n: Column) -> Column:
    return F.coalesce(n, F.lit(0)) % 2 == 1


def _after(constant: Column, swaps: Column, first: Column) -> Column:
    """The state after steps: the last constant (freed of the swaps up to it) or else the first state, swapped as often as told."""
    return F.coalesce(constant, first) != _parity(swaps)


def join_records(lines: DataFrame, layouts: DataFrame, is_banner, separators: tuple[str, ...], longest: int = LONGEST) -> DataFrame:
    """records(file, line_no, first_no, last_no, value, broken) from lines(file, line_no, value) and layouts(file, layout, sep).

    Lines of a record are joined by line feeds, and ``line_no`` is the first one's. Banner lines stay lines of their own, inside a
    quoted cell too, where they are taken out. ``broken`` says why a line belongs to no record (null if it does); ``first_no`` and ``last_no`` are
    the range of its record. Files of another layout, or without a layout, and null values keep their lines.
    """
    none = F.lit(None).cast("string")
    value = F.coalesce("value", F.lit(""))
    plain = ~(F.col("layout") == "delimited") | F.col("layout").isNull() | F.coalesce(is_banner(F.col("value")), F.lit(False))
    out, inside = F.when(plain, False), F.when(plain, True)
    for s in separators:
        a, b = ends_open(value, s)
        out, inside = out.when(F.col("sep") == s, a), inside.when(F.col("sep") == s, b)
    steps = lines.join(broadcast_if_small(layouts.select("file", "layout", "sep")), "file", "left").select(
        "file", "line_no", "value", plain.alias("_plain"), F.coalesce(out, F.lit(False)).alias("_out"), F.coalesce(inside, F.lit(True)).alias("_in"))
    steps = kept(steps, "steps")  # lines are made and matched once; what follows reads them back
    open_files = steps.where("_out").select("file").distinct().checkpoint()
    one = lambda df, broken=none: df.select("file", "line_no", F.col("line_no").alias("first_no"), F.col("line_no").alias("last_no"), "value", broken.alias("broken"))
    alone = one(steps.join(broadcast_if_small(open_files), "file", "left_anti"))
    rest = steps.join(broadcast_if_small(open_files), "file", "left_semi")
    started = _starts(rest.where(~F.col("_plain"))).checkpoint()
    many = started.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_lines"), F.max("line_no").alias("last_no"), F.bool_or("_unclosed").alias("_unclosed"))
    many = many.where((F.col("_lines") > 1) | F.col("_unclosed")).checkpoint()
    broken = F.when(F.col("_unclosed"), UNCLOSED).when(F.col("_lines") > longest, TOO_LONG)
    held = started.drop("_unclosed").join(broadcast_if_small(many), ["file", "_start"], "left").withColumn("broken", broken)
    single = one(held.where("_lines IS NULL"))
    lost = held.where("broken IS NOT NULL").select("file", "line_no", F.col("_start").alias("first_no"), "last_no", "value", "broken")
    whole = held.where("_lines IS NOT NULL AND broken IS NULL").groupBy("file", F.col("_start").alias("line_no")).agg(
        F.max("last_no").alias("last_no"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_parts"))
    whole = whole.select("file", "line_no", F.col("line_no").alias("first_no"), "last_no", F.array_join("_parts.value", "\n").alias("value"), none.alias("broken"))
    return alone.unionByName(one(rest.where("_plain"))).unionByName(single).unionByName(lost).unionByName(whole)


def _starts(steps: DataFrame) -> DataFrame:
    """(file, line_no, value, _start, _unclosed): the first line of each line's record, and whether that record has no end."""
    ranged = steps.orderBy("file", "line_no").withColumn("_range", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("_range", "file").orderBy("line_no")
    before, so_far = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("_out") & ~F.col("_in")).cast("int")
    ranged = ranged.withColumn("_swaps", F.sum(swap).over(so_far))
    ranged = ranged.withColumn("_const", F.when(F.col("_out") == F.col("_in"), F.col("_out") != _parity(F.col("_swaps"))))
    ranged = ranged.withColumns({"_n": F.sum(swap).over(before), "_c": F.last("_const", ignorenulls=True).over(before)})
    # one row for each file and range: the same sum over its ranges
    by_file = Window.partitionBy("file").orderBy("_range")
    earlier, up_to = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("file", "_range").agg(F.max("_swaps").alias("_all"), F.max_by("_const", F.when(F.col("_const").isNotNull(), F.col("line_no"))).alias("_last"))
    sums = sums.withColumn("_total", F.sum("_all").over(up_to)).withColumn("_base", (F.col("_last") != _parity(F.col("_all"))) != _parity(F.col("_total")))
    sums = sums.select("file", "_range", _after(F.last("_base", ignorenulls=True).over(earlier), F.sum("_all").over(earlier), F.lit(False)).alias("_first"))
    state = _after(F.col("_c"), F.col("_n"), F.col("_first"))
    known = ranged.join(broadcast_if_small(sums.checkpoint()), ["file", "_range"]).withColumn("_open", state)
    known = known.withColumns({"_begun": F.max(F.when(~F.col("_open"), F.col("line_no"))).over(so_far), "_ends": F.when(F.col("_open"), F.col("_in")).otherwise(F.col("_out"))})
    known = known.select("file", "line_no", "value", "_range", "_begun", "_ends").checkpoint()
    carried = known.groupBy("file", "_range").agg(F.max("_begun").alias("_latest"), F.max_by("_ends", "line_no").alias("_ends"))
    carried = carried.withColumn("_carried", F.max("_latest").over(earlier))
    last = carried.groupBy("file").agg(F.max("_latest").alias("_last_start"), F.max_by("_ends", "_range").alias("_ends_open"))
    marks = carried.select("file", "_range", "_carried").join(last, "file").checkpoint()
    start = F.coalesce("_begun", "_carried")
    return known.drop("_ends").join(broadcast_if_small(marks), ["file", "_range"]).select(
        "file", "line_no", "value", start.alias("_start"), (F.col("_ends_open") & (start == F.col("_last_start"))).alias("_unclosed"))
