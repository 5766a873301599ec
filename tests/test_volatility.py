from ledgerlens.operators import volatility as V
from tests.conftest import rows


def _hist(spark, series, client="c", kpi="total_revenue"):
    return spark.createDataFrame([(client, f"2024-{i + 1:02d}", kpi, float(p)) for i, p in enumerate(series)],
                                 "client string, period string, kpi string, pct double")


def test_thresholds(spark):
    cases = [([3.0, 4.0, 2.5], 5.0), ([2.0, 2.2, 1.9], 5.0), ([30, -15, 25], 43.5)]
    for series, expected in cases:
        t = rows(V.thresholds(_hist(spark, series)))[0]
        assert t["method"] == "volatility_mad"
        assert abs(t["threshold_pct"] - expected) < 1e-9, (series, t)


def test_short_history(spark):
    assert rows(V.thresholds(_hist(spark, [1.0, 2.0]))) == []   # client with < 3 periods: no profile
    h = _hist(spark, [1.0, 2.0, 3.0]).unionByName(_hist(spark, [5.0, 6.0], kpi="avg_x"))
    t = {r["kpi"]: r for r in rows(V.thresholds(h))}
    assert t["avg_x"]["method"] == "static_fallback" and t["avg_x"]["threshold_pct"] == 15.0


def test_latest_per_key(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("c", "p", 1, 1.0), ("c", "p", 2, 9.0)], "client string, period string, ver int, v double")
    assert rows(V.latest_per_key(df, ["client", "period"], [F.col("ver").desc()]))[0]["v"] == 9.0
