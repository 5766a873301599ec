"""Periodic runs against a plain version that tries every period."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import runs as R
from ledgerlens.llm import words as W

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, times=4, least=6):
    out = set()
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i - q
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - s >= max(least, times * q) and not any(d < q and all(words[k] == words[k - d] for k in range(s + d, i)) for d in range(1, q)):
                out.add((s, i - s, q))
    return sorted(out)


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_words(rng, letters, n):
    out = []
    while len(out) < n:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
        out += (unit * rng.randrange(1, 8))[:rng.randrange(1, 40)]
    return out


@pytest.mark.parametrize("times, least", [(2, 2), (2, 6), (3, 5), (4, 6)])
def test_automaton_finds_the_runs_of_brute_force(times, least):
    rng = random.Random(times * 10 + least)
    for k in range(150):
        words = periodic_words(rng, range(rng.randrange(1, 5)), rng.randrange(0, 120))
        assert R.segment_runs(words, times, least) == plain_runs(words, times, least)


def test_one_word_repeated_very_often():
    assert R.segment_runs([7] * 30_000) == [(0, 30_000, 1)]
    assert R.segment_runs([1, 2, 3] * 5_000) == [(0, 15_000, 3)]


def test_batches_of_texts():
    rng = random.Random(8)
    texts = [" ".join(str(w) for w in periodic_words(rng, range(rng.randrange(1, 6)), rng.randrange(0, 300))) for _ in range(60)]
    texts += ["", " ", "a", " a a a a a a ", "a a a a a", "x y " * 4, "x y " * 3 + "x"]
    words = W.split(pa.array(texts))
    found, kept = R.find_runs(words)
    got = W.joined(words, kept).to_pylist()
    for i, t in enumerate(texts):
        want = plain_runs(t.split())
        assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == want
        assert got[i] == plain_collapsed(t.split(), want)


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "go " * 9), (1, "go " * 9), (None, "a b a b a b a b"), (2, None), (3, ""), (4, " \n\t\x0b\x0c\r"), (5, "é\x1fé " * 6 + "é x"), (6, "plain words, no more"),
            (7, "w " * 50_000), (8, " ".join(f"a{i % 211}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit("c"), "_found": F.lit(0)})
    got = R.periodic_runs(df)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = [(0, 50_000, 1)] if i == 7 else [(0, 20_000, 211)] if i == 8 else plain_runs(words)
        want.append((i, runs, plain_collapsed(words, runs)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str) == sorted(want, key=str)
    assert R.periodic_runs(df.limit(0)).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contract_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(plain_collapsed(words, runs)))


def test_query_equals_brute_force(spark, tmp_path):
    from ledgerlens.llm.queries import QUERIES

    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 3000)
    more = [(10**6 + i, " ".join(str(w) for w in periodic_words(rng, range(4), rng.randrange(0, 90)))) for i in range(300)] + [(2 * 10**6, None), (2 * 10**6 + 1, "")]
    made = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    made.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    want = {r.doc_id: contract_row(r.doc_id, r.text) for r in made.collect()}
    assert got == want
    assert sum(r[0] > 0 for i, r in got.items() if i < 10**6) > 5
