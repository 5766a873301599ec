"""Golden filters, sketches, push batches, pseudonyms and logs beside their registered queries."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import dates as D
from ledgerlens.operators import golden_filters as GF
from ledgerlens.operators import pseudonyms as PS
from ledgerlens.operators import sketch as SK
from ledgerlens.sources import sinks as SI


@pytest.mark.parametrize("text, sql", [
    ("", "(TRUE)"), ("ALL(sales)", "(TRUE)"), ("ALL('my sales'[region])", "(TRUE)"), ('sales[region] = "Rīga"', "(`region` = 'Rīga')"),
    ('[Region] = "say ""hi"" it\'s"', "(`region` = 'say \"hi\" it\\'s')"), ("sales[qty] >= 1.5 && NOT [qty] <> 3", "(`qty` >= 1.5 AND NOT `qty` <> 3)"),
    ('sales[region] IN {"a", "b"}, [qty] < 3', "(`region` IN ( 'a' , 'b' ) ) AND ( `qty` < 3)"), ("[region] = BLANK()", "(`region` IS NULL)")])
def test_filters_become_sql(text, sql):
    assert GF.to_sql(text, ["region", "qty"]) == sql


@pytest.mark.parametrize("text", ["sales[colour] = 1", "region; drop", "qty + 1", "CALCULATE([qty])", '"open'])
def test_other_signs_are_refused(text):
    with pytest.raises(GF.UnreadableFilter):
        GF.to_sql(text, ["region", "qty"])


def test_sketches_merge_and_count(spark):
    df = spark.range(30_000).select(F.lit("c").alias("client"), (F.col("id") % 7000).alias("many"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("few"), F.lit(None).cast("double").alias("none"))
    whole = {r.column_name: r for r in SK.sketch(df, "t", "client", 256).collect()}
    half = F.col("many") % 2 == 0
    parts = SK.sketch(df.where(half), "t", "client", 256).unionByName(SK.sketch(df.where(~half), "t", "client", 256))
    merged = {r.column_name: r for r in SK.merge(parts, 256).collect()}
    assert merged == whole
    card = {r.column_name: r.cardinality for r in SK.as_profile(SK.sketch(df, "t", "client", 256), 256).collect()}
    assert card["few"] == 40 and card["none"] == 0 and abs(card["many"] - 7000) < 7000 * 4 / 16
    assert whole["none"].null_count == 30_000 and whole["few"].samples == sorted(whole["few"].samples) and len(whole["few"].samples) == SK.SAMPLES


def test_a_bound_that_is_too_low_is_taken_back(spark, monkeypatch):
    df = spark.range(5000).select(F.lit("c").alias("client"), "id")
    want = SK.sketch(df, "t", "client", 256).collect()
    monkeypatch.setattr(SK, "SPARE", 0.2)
    assert SK.sketch(df, "t", "client", 256).collect() == want and len(want[0].hashes) == 256
    assert SK.sketch(df.limit(0), "t", "client").count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_push_batches_do_not_depend_on_partitions(spark, parts):
    df = spark.range(95).select(F.col("id").alias("k"), F.lit("x").alias("batch")).repartition(parts)
    got = sorted((r.hour, r.batch, r.place, r.k) for r in SI.push_plan(df, ["k"], 10, 30).collect())
    assert got == [(i // 30, i // 10, i % 10, i) for i in range(95)]
    assert SI.push_plan(df.limit(0), ["k"]).count() == 0


def test_pseudonyms_are_hmacs_and_the_mapping_only_grows(spark, tmp_path):
    key, path = b"0123456789abcdef", str(tmp_path / "map")
    names = spark.createDataFrame([("Ann",), ("Ann",), ("Žan 😀",), (None,), ("",)], "name string")
    got = {r.name: r.pseudonym for r in PS.append_mapping(names, path, key, "a").collect()}
    assert got == {n: "p_" + hmac.new(key, n.encode(), hashlib.sha256).hexdigest()[:32] for n in ("Ann", "Žan 😀", "")}
    again = PS.append_mapping(spark.createDataFrame([("Ann",), ("Bo",)], "name string"), path, key, "b")
    assert sorted((r.name, r.first_run) for r in again.collect()) == [("", "a"), ("Ann", "a"), ("Bo", "b"), ("Žan 😀", "a")]
    assert PS.collisions(again).count() == 0
    other = again.unionByName(PS.new_entries(spark.createDataFrame([("Ann",)], "name string"), again.limit(0), b"another key of 16", "c"))
    assert [tuple(r) for r in PS.collisions(other).collect()] == [("name", "Ann", 2)]
    with pytest.raises(ValueError):
        PS.keyed_pseudonym(F.col("name"), b"short")


def test_log_lines_are_all_accounted_for(spark, tmp_path):
    good = json.dumps({"report_id": "r1", "client_name": "c", "unknown": 1})
    (tmp_path / "a.json").write_text("\n".join([good, "", "{\"report_id\": \"r2\"", json.dumps({"client_name": "c"}), json.dumps({"report_id": "r3", "gate_passed": "maybe"}), "[1]"]) + "\n")
    (tmp_path / "b.json").write_text(good + "\n" + json.dumps({"report_id": "r4", "late_correction": True}) + "\n")
    lines = AU.log_lines(spark, str(tmp_path))
    got = sorted((r.file[-6], r.status, r.reason or "", r.record.report_id if r.record else "") for r in lines.collect())
    assert got == sorted([("a", "read", "", "r1"), ("a", "rejected", "blank", ""), ("a", "rejected", "malformed", ""), ("a", "rejected", "no_key", ""),
                          ("a", "rejected", "malformed", ""), ("a", "rejected", "malformed", ""), ("b", "repeated", "", "r1"), ("b", "read", "", "r4")])
    assert sorted((r.report_id, r.late_correction) for r in AU.read_log_once(lines).collect()) == [("r1", False), ("r4", True)]


def test_date_statistics_need_no_row_twice_and_see_repeated_times(spark):
    rows = [("c", "2024-03", f"2024-03-{1 + i // 2:02d} 0{i % 2}:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "client string, period string, t string").select("client", "period", F.col("t").cast("timestamp").alias("t"), F.to_date("t").alias("d"))
    unique = {r.column_name: r.unique for r in D.date_stats(df, ["t", "d"], "2024-03-31").collect()}
    assert unique == {"t": True, "d": False}
    twice = {r.column_name: r.unique for r in D.date_stats(df.union(df.limit(1)), ["t"], "2024-03-31").collect()}
    assert twice == {"t": False}
    plans = []
    plain = type(df).checkpoint
    try:
        type(df).checkpoint = lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self, *a, **k)
        D.date_stats(df, ["t", "d"], "2024-03-31").collect()
    finally:
        type(df).checkpoint = plain
    assert plans and not any("Expand" in p for p in plans)


def test_sketches_sort_no_rows_of_frequent_values(spark, monkeypatch):
    """The aggregate that meets all rows has no text buffer; only the one over distinct values has."""
    seen = []
    row_number = F.row_number

    def spy():
        seen.append(True)
        return row_number()

    monkeypatch.setattr(SK.F, "row_number", spy)
    df = spark.range(1000).select(F.lit("c").alias("client"), F.concat(F.lit("v"), F.col("id") % 3).alias("few"))
    counts = spark.createDataFrame([("c", 0, SK._TOP)], "client string, _i int, _bound long")
    plan = SK._smallest(df, ["few"], "client", counts, 16)._jdf.queryExecution().executedPlan().toString()
    assert seen and plan.count("HashAggregate") >= 2
    below = plan[plan.index("Generate") - 2000:plan.index("Generate")]
    assert "HashAggregate" in below[below.rindex("Aggregate") - 4:]
