import hashlib
import re

from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup as E

from .oracle import same


def test_query_equals_sql(spark):
    same(spark, "op2_exact_dedup")


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = "word " * 400
    rows = [(5, "a  b", 1), (2, "a\t\nb", 2), (2, "a b", 3), (9, None, 4), (8, "", 5), (None, "a b", 6), (None, "only null", 7), (None, "only  null", 8),
            (11, long + "x", 9), (12, long + "y", 10), (13, long.replace(" ", "\r\n") + "y", 11), (14, " a b", 12), (15, "a b", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumns({"full_hash": F.lit("mine"), "keep_id": F.lit(0), "id": F.lit(1)})
    got = E.exact_duplicates(df, columns=df.columns).collect()
    assert len(got) == len(rows) and got[0].rec.full_hash == "mine"
    groups = {}
    for i, t, n in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, n))
    for r in got:
        group = groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.rec.text or "")]
        first = min(group)
        assert (r.keep_id, r.group_size) == (None if first[0] else first[1], len(group))
    kept = [r.rec.length for r in got if r.kept]
    assert len(kept) == len(groups) and {next(n for n in [r.rec.length] if r.kept) for r in got if r.kept} == set(kept)
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", r.rec.text or "") for r in got if r.kept} == set(groups)
    hashed = [r for r in got if r.full_hash]
    assert all(r.full_hash == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.rec.text or "").encode()).hexdigest() for r in hashed)
    assert all(r.group_size == 1 for r in got if not r.full_hash) and len(hashed) < len(rows)  # the rest is never hashed in full
    assert E.drop_duplicates(df).columns == df.columns and E.drop_duplicates(df).count() == len(groups)


def test_prefixes_are_hashed_only_where_the_length_repeats(spark):
    keyed = spark.createDataFrame([("aa", 2), ("bb", 2), ("aa", 2), ("c", 1), ("", 0)], "norm string, length int")
    got = E.prefixed(keyed, E.repeated_lengths(keyed), 256)
    assert sorted((r.norm, r.prefix is None) for r in got.collect()) == [("", True), ("aa", False), ("aa", False), ("bb", False), ("c", True)]
    assert [r.length for r in E.repeated_prefixes(got).collect()] == [2]


def test_empty_table(spark):
    assert E.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
