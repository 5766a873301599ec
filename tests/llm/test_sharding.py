import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import sharding as S


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(3000)] + [0, 1, 2**64 - 1]
    for shards in (1, 2, 8, 9, 100):
        assert S.jump_hash(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_growth_moves_rows_into_the_new_shards_only():
    keys = np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64)
    old, new = S.jump_hash(keys, 8), S.jump_hash(keys, 9)
    moved = old != new
    assert set(new[moved]) == {8} and abs(moved.mean() - 1 / 9) < 0.01
    assert np.abs(np.bincount(old) / len(keys) - 1 / 8).max() < 0.01


def check(rows, docs):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    for shard in range(8):
        slots = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in rows if r.shard == shard)
        assert [s[0] for s in slots] == list(range(len(slots)))
        assert [s[1:] for s in slots] == sorted(s[1:] for s in slots)
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in rows}) == len({r.doc_id for r in rows})


def test_nulls_repeats_hot_key_and_clashing_columns(spark):
    docs = [(7, "hot")] * 500 + [(i, "é" * i) for i in range(200)] + [(None, "x"), (None, None), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit("a"), "slot": F.lit(1), "size": F.lit(2), "row": F.lit(3)}).repartition(7)
    check(S.assign_shards(df).collect(), docs)


def test_empty_table(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_smallest_table(spark):
    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op5_jump_sharding"](spark, sf).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert {r.law for r in rows} == {"key"}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_id string, n int")
    S.write_shards(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.doc_id, r.n) for r in back.collect()} == {("a", 1), ("b", 2), (None, 3)}
