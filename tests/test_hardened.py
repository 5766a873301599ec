from pyspark.sql import functions as F

from ledgerlens.plans import hardened as H

from conftest import SF001


def test_previous_value_over_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        for n in (0, 1, 5, 500):
            ids = [f"{i:04}" for i in range(n)]
            df = spark.createDataFrame([(i,) for i in reversed(ids)], "id string")
            assert sorted((r.id, r.before or "") for r in H._with_previous(df, "id", "before").collect()) == list(zip(ids, ["", *ids]))
        assert df.orderBy("id").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set(key, held)


def test_long_chain_sorts_no_table_in_one_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(H.AU, "supersedes_chain", lambda spark, audit: seen.append(audit) or audit)
    H.q_long_chain(spark, SF001)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line for line in windows)
