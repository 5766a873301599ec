import datetime as dt
import json
import os

from pyspark.sql import functions as F

from ledgerlens.operators import snapshot as snap
from ledgerlens.sources import sinks as SK
from ledgerlens.streaming.incremental import read_aggregate, start_incremental_aggregate
from tests.conftest import rows

SCHEMA = "client string, period string, date timestamp, revenue double, qty double"


def _batch(spark, period, month, n, v):
    return spark.createDataFrame([("acme", period, dt.datetime(2024, month, 1 + i % 20), float(v), 1.0)
                                  for i in range(n)], SCHEMA)


def test_incremental_matches_batch(spark, tmp_path):
    src, table, ck = str(tmp_path / "src"), str(tmp_path / "agg"), str(tmp_path / "ck")
    b1, b2, b3 = _batch(spark, "2024-02", 2, 20, 10), _batch(spark, "2024-03", 3, 15, 12), _batch(spark, "2024-03", 3, 5, 30)
    b1.write.parquet(os.path.join(src, "f1"))
    start_incremental_aggregate(spark, src + "/*", SCHEMA, ["revenue", "qty"], "date", table, ck).awaitTermination()
    b2.write.parquet(os.path.join(src, "f2"))
    b3.write.parquet(os.path.join(src, "f3"))
    start_incremental_aggregate(spark, src + "/*", SCHEMA, ["revenue", "qty"], "date", table, ck).awaitTermination()
    inc = snap.kpis_from_aggregate(read_aggregate(spark, table), ["revenue", "qty"])
    full = snap.kpi_table(b1.unionByName(b2).unionByName(b3), ["revenue", "qty"], "date")
    key = lambda r: (r["period"], r["kpi"])
    assert sorted(rows(inc), key=key) == sorted(rows(full), key=key)


def test_push_batches_and_upsert(spark, tmp_path):
    df = spark.range(25).select(F.col("id"), F.lit(None).cast("string").alias("note"),
                                F.lit(dt.datetime(2024, 3, 1, 8, 30)).alias("ts"))
    SK.write_push_batches(df, str(tmp_path / "push"), batch_rows=10)
    files = [f for f in os.listdir(tmp_path / "push") if f.endswith(".json")]
    n = [len(open(tmp_path / "push" / f).read().splitlines()) for f in files]
    assert sum(n) == 25 and max(n) <= 10
    first = json.loads(open(tmp_path / "push" / files[0]).readline())
    assert first["note"] is None and first["ts"] == "2024-03-01T08:30:00"
    old = spark.createDataFrame([("a", "p", 1, 1.0), ("b", "p", 1, 2.0)], "client string, period string, v int, x double")
    new = spark.createDataFrame([("a", "p", 2, 9.0)], "client string, period string, v int, x double")
    got = {r["client"]: r["x"] for r in SK.keyed_upsert(old, new, ["client", "period"], "v").collect()}
    assert got == {"a": 9.0, "b": 2.0}
