"""Records of quoted cells over several lines, against Python's csv reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import records as R
from ledgerlens.sources import scan as SC


def plain_records(text):
    """[(first line, last line, cells)], and the first line of a record without an end (or None)."""
    lines, out, at, held = text.split("\n"), [], 0, []
    for i, line in enumerate(lines):
        held.append(line)
        body = "\n".join(held)
        if not _open(body):
            out.append((at, i, next(csv.reader(io.StringIO(body, newline=""), delimiter=";"), [""])))
            at, held = i + 1, []
    return out, at if held else None


def _open(body):
    state = "start"
    for c in body:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == ";" else "cell"
        elif state == "cell":
            state = "start" if c == ";" else "cell"
        elif state == "quoted":
            state = "maybe" if c == '"' else "quoted"
        else:  # a quote inside a quoted cell
            state = "quoted" if c == '"' else "start" if c == ";" else "cell"
    return state == "quoted"


def _found(spark, texts, **more):
    rows = [(f"f{k}", i, v) for k, t in enumerate(texts) for i, v in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "file string, line_no long, value string")
    layouts = spark.createDataFrame([(f"f{k}", "delimited", ";") for k in range(len(texts))], "file string, layout string, sep string")
    return R.join_records(lines, layouts, SC.is_banner, SC.SEPARATORS, **more).withColumns({"layout": F.lit("delimited"), "sep": F.lit(";")})


def test_random_files_equal_the_csv_reader(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('ab;"""\n\n;é') for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    texts += ["a;b\n1;2", '"', '""', 'x\n"a\n\n\nb";c\n"d', '5" pipe;3\n1;2']
    got = {}
    for r in _found(spark, texts).withColumn("cells", SC.split_cells(F.col("value"))).collect():
        got.setdefault(int(r["file"][1:]), []).append(r)
    for k, t in enumerate(texts):
        want, lost = plain_records(t)
        rows = sorted(got[k], key=lambda r: r["line_no"])
        assert [(r["first_no"], r["last_no"], r["cells"]) for r in rows if r["broken"] is None] == want, t
        bad = [(r["line_no"], r["first_no"], r["broken"]) for r in rows if r["broken"]]
        assert bad == ([] if lost is None else [(i, lost, R.UNCLOSED) for i in range(lost, t.count("\n") + 1)]), t


def test_records_cross_ranges_of_one_long_file(spark):
    rng = random.Random(1)
    cells = [rng.choice(["x", 'say "hi"', "one\ntwo", "\n\n\n", 'a;b\n"c"']) for _ in range(4000)]
    text = "\n".join(f'{i};"{c}"'.replace(c, c.replace('"', '""')) if c != "x" else f"{i};x" for i, c in enumerate(cells))
    got = _found(spark, [text]).withColumn("cells", SC.split_cells(F.col("value"))).orderBy("line_no").collect()
    assert [r["cells"] for r in got] == [[str(i), c] for i, c in enumerate(cells)]


def test_too_long_records_are_rejected_line_by_line(spark):
    got = _found(spark, ['a;b\n"1\n2\n3\n4";x\n5;6\n"7\n8";9'], longest=3).orderBy("line_no").collect()
    assert [(r["line_no"], r["first_no"], r["last_no"], r["broken"]) for r in got] == [
        (0, 0, 0, None), (1, 1, 4, R.TOO_LONG), (2, 1, 4, R.TOO_LONG), (3, 1, 4, R.TOO_LONG), (4, 1, 4, R.TOO_LONG), (5, 5, 5, None), (6, 6, 7, None)]


@pytest.mark.parametrize("sep", SC.SEPARATORS)
def test_header_over_two_lines_and_banner_inside_a_cell(spark, sep):
    text = ["Report x", f'"na', f'me"{sep}n', f'"a', "Period 2024", f'b"{sep}1', f'c{sep}2']
    lines = spark.createDataFrame([("q.csv", i, v) for i, v in enumerate(text)], "file string, line_no long, value string")
    parsed = SC.materialise_parsed(lines)
    if parsed.where("layout = 'pipe'").count():
        return  # pipe reports have no quotes
    (t,) = SC._tables(parsed, None).values()
    assert t.columns == ["source_file", "na_me", "n"]
    assert sorted(tuple(r)[1:] for r in t.collect()) == [("a\nb", "1"), ("c", "2")]
    assert sorted((r["line_no"], r["reason"]) for r in SC.scan_rejects(parsed).collect()) == [(0, "banner"), (1, "header"), (4, "banner")]


def test_lines_without_layout_nulls_and_empty_tables(spark):
    lines = spark.createDataFrame([("f", 0, None), ("f", 1, '"x'), ("g", 0, '"y')], "file string, line_no long, value string")
    layouts = spark.createDataFrame([("f", "pipe", "|")], "file string, layout string, sep string")
    got = R.join_records(lines, layouts, SC.is_banner, SC.SEPARATORS)
    assert sorted((r["file"], r["line_no"], r["value"], r["broken"]) for r in got.collect()) == [("f", 0, None, None), ("f", 1, '"x', None), ("g", 0, '"y', None)]
    assert R.join_records(lines.limit(0), layouts, SC.is_banner, SC.SEPARATORS).count() == 0
