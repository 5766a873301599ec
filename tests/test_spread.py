from ledgerlens.operators.spread import spread

from conftest import SF001


def test_scan_is_spread_on_its_key_whatever_its_splits(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df, key in ((spark.read.parquet(f"{SF001}/documents.parquet"), "doc_id"), (spark.range(0, 1000, numPartitions=64), "id")):
        plan = spread(df, key)._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning({key}" in plan and f", {n})" in plan
        assert spread(df, key).count() == df.count()


def test_fact_joins_line_items_with_a_sort_merge_join(spark):
    from ledgerlens.sources.testdata import sales_fact
    plan = sales_fact(spark, SF001, dims=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BuildLeft" not in plan      # the line items are never the broadcast side
