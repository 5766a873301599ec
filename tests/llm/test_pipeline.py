"""Each stage of the pipeline, on what the stage before kept, against brute force."""

import re

import corpus_pipeline as P
from ledgerlens.llm import langid

from .test_packing import check
from .test_simhash import plain_fingerprint, roots

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_equal_brute_force_and_run_chains_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    functions = dict(P.STAGES)
    assert list(functions) == ["language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]

    told = functions["language_id"](spark, docs, SF)
    classifier = langid.Classifier(langid.learn(docs), 0.005)
    first = [tuple(r) for r in docs.collect()]
    want = [r for r in first if classifier.predict(r[1])[2]]
    assert told.columns == docs.columns and rows(told) == sorted(want, key=repr) and len(want) >= 0.97 * len(first)

    unique = functions["exact_dedup"](spark, told, SF)
    keep = {}
    for r in sorted(want):
        keep.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    want = list(keep.values())
    assert unique.columns == docs.columns and rows(unique) == sorted(want, key=repr) and len(want) < len(first)

    near = functions["simhash_near_dedup"](spark, unique, SF)
    prints = {r[0]: plain_fingerprint(r[1] or "") for r in want}
    root, least = roots(set(prints.values()), 3), {}
    for i, f in prints.items():
        least[root[f]] = min(least.get(root[f], i), i)
    want = [r for r in want if least[root[prints[r[0]]]] == r[0]]
    assert near.columns == docs.columns and rows(near) == sorted(want, key=repr)

    packed = functions["best_fit_packing"](spark, near, SF).collect()
    check(packed, [(r[0], r[1]) for r in want])

    whole = P.run(spark, SF).collect()
    place = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in place) for r in whole) == sorted(tuple(r[c] for c in place) for r in packed)


def test_registered(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is P.run and ("pipeline" in E.oracle_sql()) == (P.ORACLE_SQL is not None)
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in E.queries() if k.startswith("op")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
