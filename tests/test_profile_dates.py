import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import dates as D
from ledgerlens.operators import profile as P
from tests.conftest import rows


def _sales(spark):
    data = [(dt.datetime(2024, 3, 1 + i % 3), ["A", "B", "C"][i % 3], ["N", "S", "E"][i % 3], i % 3, 1.5 * (i % 3),
             i % 3) for i in range(30)]
    return spark.createDataFrame(data, "date timestamp, customer string, region string, qty bigint, unit_price double, "
                                       "discount_pct bigint")


def test_roles_and_fact(spark):
    dim = spark.createDataFrame([("P1", "Widget"), ("P2", "Gadget")], "product_code string, name string")
    prof = P.profile({"sales": _sales(spark), "dim_product": dim})
    roles = {r["column_name"]: r["role"] for r in P.roles(prof).where("table_name = 'sales'").collect()}
    assert roles["date"] == "date" and roles["customer"] == "text_dimension"
    assert roles["qty"] == roles["unit_price"] == roles["discount_pct"] == "numeric_measure"  # 3/30 > 0.05
    fs = {r["table_name"]: r["is_fact"] for r in P.fact_selection(prof, ["sales", "dim_product"]).collect()}
    assert fs == {"sales": True, "dim_product": False}
    keys = rows(P.dim_keys(prof, P.fact_selection(prof, ["sales", "dim_product"])))
    assert keys == [{"table_name": "dim_product", "key_column": "product_code", "key_is_id_or_unique": True}]


def test_drift(spark):
    base = spark.createDataFrame([(1.0, "N", 2.0)], "revenue double, region string, cost double")
    fp = P.profile({"t": base})
    assert rows(P.drift(fp, fp)) == []
    missing = P.profile({"t": base.drop("cost").withColumn("new_col", F.lit("x"))})
    assert {(r["column_name"], r["code"]) for r in P.drift(fp, missing).collect()} == {
        ("cost", "COLUMN_MISSING"), ("new_col", "COLUMN_ADDED")}
    retyped = P.profile({"t": base.withColumn("revenue", F.col("revenue").cast("string"))})
    assert [r["code"] for r in P.drift(fp, retyped).collect()] == ["TYPE_REGRESSION"]


def _dates(spark, days, col="date", period="2024-03"):
    return spark.createDataFrame([("c", period, d) for d in days], f"client string, period string, {col} timestamp")


def _issues(df, cands=("date",), as_of="2024-03-31"):
    return sorted(r["code"] for r in D.date_issues(D.date_stats(df, cands, as_of)).collect())


def test_date_validation(spark):
    march = [dt.datetime(2024, 3, d) for d in range(1, 21)]
    assert _issues(_dates(spark, march)) == ["ALL_DATES_UNIQUE"]
    assert _issues(_dates(spark, march), ("ship_date",)) == ["COLUMN_NOT_FOUND"]
    nulls = _dates(spark, march[:1] + [None] * 19)
    assert "HIGH_NULL_RATE" in _issues(nulls)
    jan = [dt.datetime(2024, 1, d) for d in range(1, 21)]
    assert "PERIOD_MISMATCH" in _issues(_dates(spark, jan))
    future = _dates(spark, march[:19] + [dt.datetime(2024, 5, 1)])
    assert "FUTURE_DATES" in _issues(future)
    text = spark.createDataFrame([("c", "2024-03", "01.03.2024"), ("c", "2024-03", "02.03.2024")],
                                 "client string, period string, date string")
    assert "DATE_NOT_PARSED" in _issues(text)
    junk = spark.createDataFrame([("c", "2024-03", "abc"), ("c", "2024-03", "x")], "client string, period string, date string")
    assert _issues(junk) == ["NOT_A_DATE"]


def test_pick_date_column(spark):
    d = [dt.datetime(2024, 3, 1 + i % 10) for i in range(20)]
    df = spark.createDataFrame([("c", "2024-03", a, a, a) for a in d],
                               "client string, period string, order_date timestamp, ship_date timestamp, posted_date timestamp")
    st = D.date_stats(df, ["order_date", "ship_date", "posted_date"], "2024-03-31")
    summ = D.date_summary(st, D.date_issues(st))
    assert rows(D.pick_date_column(summ))[0]["status"] == "ambiguous"
    assert rows(D.pick_date_column(summ, explicit="ship_date"))[0]["date_column"] == "ship_date"
    bad = df.withColumn("order_date", F.lit(None).cast("timestamp")).withColumn("ship_date", F.lit(None).cast("timestamp")) \
        .withColumn("posted_date", F.when(F.col("posted_date") < "2024-03-05", None).otherwise(F.col("posted_date")))
    st2 = D.date_stats(bad, ["order_date", "ship_date", "posted_date"], "2024-03-31")
    pick = rows(D.pick_date_column(D.date_summary(st2, D.date_issues(st2))))[0]
    assert pick == {"client": "c", "period": "2024-03", "date_column": "posted_date", "status": "least_broken",
                    "n_passing": 0}


def test_approximate_profile_is_near_the_exact_one(spark):
    from ledgerlens.operators import profile as P

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    exact = {r.column_name: r for r in P.profile({"lineitem": li}, samples=False).collect()}
    near = P.profile({"lineitem": li}, approximate=True)
    assert "Generate explode" not in near._jdf.queryExecution().toString()
    for r in near.collect():
        e = exact[r.column_name]
        assert (r.row_count, r.null_count, r.dtype) == (e.row_count, e.null_count, e.dtype)
        assert abs(r.cardinality - e.cardinality) <= 0.15 * e.cardinality + 1


def test_dates_are_read_as_by_every_format_in_turn(spark):
    texts = ["2001-01-01", "2001-01-01 10:11:12", "2001-01-01t10:11Z", "1/2/01", "01.02.2001", "1-2-2001", "2001/1/2", "+12001-01-01", "-1/2/2001", "31/02/2001", " 2001-01-01",
             "2001-01-01\n", "5-LOW", "1234.56", "word", "", None]
    plain = F.coalesce(*[F.try_to_timestamp("v", F.lit(f)) for f in D.DATE_FORMATS])
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert df.where(~D.parse_date(F.col("v")).eqNullSafe(plain)).count() == 0


def test_formats_are_only_tried_on_texts_of_their_shape(spark):
    import time

    def seconds(text):
        df = spark.range(0, 60_000, 1, 1).select(F.concat(F.lit(text), "id").alias("v"))
        begun = time.perf_counter()
        assert df.agg(F.count(D.parse_date(F.col("v"))).alias("n")).first().n == 0
        return time.perf_counter() - begun

    seconds("warm")
    plain = spark.range(0, 60_000, 1, 1).select(F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("w"), "id"), F.lit(f)) for f in D.DATE_FORMATS]).alias("d"))
    begun = time.perf_counter()
    plain.agg(F.count("d")).collect()
    assert seconds("w") * 3 < time.perf_counter() - begun


def test_profile_groups_typed_values_and_keeps_their_texts(spark):
    df = spark.createDataFrame([(0.0, 1, "a"), (-0.0, 10, None), (float("nan"), 9, "a"), (float("nan"), None, ""), (None, 2, "b"), (2.5, 10, "b")], "x double, k bigint, s string")
    got = {r.column_name: (r.row_count, r.cardinality, r.null_count, r.samples) for r in P.profile({"t": df}).collect()}
    assert got == {"x": (6, 4, 1, "-0.0|0.0|2.5|NaN"), "k": (6, 4, 1, "1|10|2|9"), "s": (6, 3, 1, "|a|b")}
    plan = P.profile({"t": df})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row is unpivoted
    by = {(r.s, r.column_name): (r.row_count, r.cardinality, r.samples) for r in P.profile({"t": df}, group="s").collect()}
    assert by[("a", "x")] == (2, 2, "0.0|NaN") and by[("b", "k")] == (2, 2, "10|2")
