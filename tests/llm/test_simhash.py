"""SimHash components against brute force over planted fingerprints and texts."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash as S


def plain_fingerprint(text, k=3, seed=42):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    grams = [words[i:i + k] for i in range(len(words) - k + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def roots(nodes, distance):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One TWO", "a b c", "É é x Y z q \x1f w", "ab " * 700, "x\x0by z\x0cq r"])
def test_fingerprint_equals_plain_one(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_a_text_longer_than_a_block(monkeypatch):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**9)) for _ in range(3000))
    monkeypatch.setattr(S, "TEXT_BLOCK", 64)
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_links_join_the_same_fingerprints_as_brute_force(spark, distance):
    rng = random.Random(distance)
    seen = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for i in rng.sample(range(64), rng.randrange(0, 9)):
                x ^= 1 << i
            seen.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in seen]
    df = spark.createDataFrame([(x,) for x in signed + signed[:5] + [None]], "fp long")
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in S.fingerprint_links(df, distance).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b and bin(a ^ b).count("1") <= distance for a, b in pairs)
    want, parent = roots(seen, distance), {n: n for n in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {n: find(n) for n in seen} == want


def test_large_block_is_compared_in_passes(monkeypatch):
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**12, 400).astype(np.uint64) << np.uint64(32))
    whole = {tuple(p) for block in S._match(0, np.zeros(len(fp), np.uint64), fp, 3) for p in block.tolist()}
    monkeypatch.setattr(S, "VARIANT_BLOCK", 1 << 10)
    parts = {tuple(p) for block in S._match(0, np.zeros(len(fp), np.uint64), fp, 3) for p in block.tolist()}
    assert whole == parts and whole


def test_components_with_nulls_ties_repeats_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base, 1), (3, base, 1), (3, base, 1), (9, base + " tail", 2), (1, None, 3), (2, "", 3), (None, base, 4), (None, "alone here now", 5), (11, "Solo", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x")).withColumn("root", F.lit(0))
    got = [tuple(r) for r in S.simhash_components(df).collect()]
    prints = {t or "": plain_fingerprint(t or "") for _, t, _ in rows}
    root, least = roots(set(prints.values()), 3), {}
    for i, t, _ in rows:
        if i is not None:
            k = root[prints[t or ""]]
            least[k] = min(least.get(k, i), i)
    want = [(i, int(np.uint64(prints[t or ""]).astype(np.int64)), least.get(root[prints[t or ""]])) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_representatives_with_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base, 1), (3, base, 2), (3, base, 3), (9, base + " tail", 4), (None, "alone here now", 5), (None, "alone here now", 6), (3, "other words of that id", 7), (1, None, 8), (2, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumns({"row": F.lit("r"), "rec": F.lit(0), "id": F.lit(1)})
    kept = S.keep_representatives(df)
    assert kept.columns == df.columns
    got = sorted(r.fp for r in kept.collect())
    assert len(got) == 4 and set(got) - {2, 3, 5, 6} == {7, 8}


def test_empty_table(spark):
    assert S.keep_representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force_on_the_smallest_table(spark):
    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    docs = {r.doc_id: plain_fingerprint(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    root = roots(set(docs.values()), 3)
    least = {}
    for i, f in docs.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in docs.items()}
