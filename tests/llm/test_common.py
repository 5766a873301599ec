"""Names of rows, and tables in the scratch folder."""

import os

from pyspark.sql import functions as F

from ledgerlens.llm import common as C


def test_rows_of_a_scan_keep_their_names_and_others_are_written_first(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).withColumn("text", F.lit("x")).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = C.numbered(docs)
    names = {(r.row.file, r.row.at): r.rec.id for r in rows.collect()}
    assert len(names) == 40 and names == {(r.row.file, r.row.at): r.rec.id for r in C.numbered(spark.read.parquet(path).where("id >= 0")).collect()}
    gone = rows.where("rec.id % 2 = 0")
    assert sorted(r.id for r in C.without(rows, gone).collect()) == list(range(1, 40, 2))
    twice = docs.union(docs).withColumn("_metadata", F.lit(1))
    assert not C._scanned(twice) and len({(r.row.file, r.row.at) for r in C.numbered(twice).collect()}) == 80
    assert not C._scanned(docs.select("id", F.explode(F.array(F.lit(1), F.lit(2)))))


def test_scratch_tables_are_deleted_when_they_are_done_with(spark):
    df = C.materialise_table(spark.range(3))
    path = C._written[df].removeprefix("file:")
    assert os.path.isdir(path) and C.delete_at_end(spark, path) and not C.delete_at_end(spark, path + "-none")
    C.discard(df, df)
    assert not os.path.exists(path)
