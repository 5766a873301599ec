import math
import random

from pyspark.sql import functions as F

from ledgerlens.llm import topk as T

from .oracle import same


def plain(rows, asks, k):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i is not None and asks(i):
            scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j is None, j or 0, m) for m, j, w in ok if m != n)
            out += [(i, r, None if none else j, -s) for r, (s, none, j, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(df, asks, k):
    return sorted(map(tuple, T.top_k(df, asks, k).collect()), key=repr)


def test_query_equals_sql(spark):
    same(spark, "op4_exact_top_k")


def test_ties_nulls_repeats_and_uneven_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, 1.0, 0.001]) for _ in range(6)]) for i in range(120)]
    rows += [(10, [1.0] * 6), (10, [1.0] * 6), (20, [1.0] * 6), (None, [1.0] * 6), (200, None), (210, [None, 1.0]), (220, [float("nan")]), (230, [float("inf"), 0.0]),
             (240, []), (250, [2.0, 1.0, 0.5, 3.0, 4.0, 5.0, 6.0, 7.0]), (260, [0.0] * 6)] + [(1000 + i, [0.5] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit(1), "id": F.lit(2), "score": F.lit("s"), "vector": F.lit(0)}).repartition(3)
    assert found(df, F.col("vec_id") % 10 == 0, 5) == plain(rows, lambda i: i % 10 == 0, 5)


def test_small_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    rows = [(i, [float((i * 7) % 5), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, F.col("vec_id") % 2 == 0, 5) == plain(rows, lambda i: i % 2 == 0, 5)
    few = rows[:3]
    assert found(spark.createDataFrame(few, "vec_id long, embedding array<double>"), F.lit(True), 5) == plain(few, lambda i: True, 5)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 5.0]), (3, [1.0, 1.0]), (4, [2.0**50, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, F.col("vec_id") >= 0, 5) == plain(rows, lambda i: True, 5)


def test_empty_table_and_no_query(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(empty, F.lit(True)).count() == 0
    assert T.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.lit(False)).count() == 0
