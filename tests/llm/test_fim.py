"""Fill-in-middle against a plain version and the SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import fim

from .oracle import same

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(key, text, seed=42):
    """(n, form, output, prefix_chars, middle_chars, suffix_chars)"""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    u = UNIT.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", text, None, None, None
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(u), *out, len(p), len(m), len(s)


def test_equals_the_plain_version(spark):
    rng = random.Random(5)
    signs = ["a", "bc", " ", "  ", "\n", "\t", "\x0b", "\x1f", " ", " ", "é", "😀", "<", ">", "P>", "<P", "$1", "\\", "\\E", "<S", "{2}", "\0"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x <M> y"), (1004, "<P>"), (None, "no id here at all"), (None, None)]
    rows += [(2000 + i, "word " * 60_000 + "end") for i in range(4)] + [(3000 + i, "y" * 300_000) for i in range(3)] + [(4000 + i, " \n" * 90_000) for i in range(3)]
    rows += [rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "form": F.lit(1), "output": F.lit(None), "_a": F.lit(7), "x.y": F.lit(0)})
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "x.y", *fim.ADDED]
    got = made.withColumn("restored", fim.restore("output", "form")).drop("x.y").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        assert tuple(r)[2:8] == plain(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("$1", "<S>", "<M>"), ("ab", "bc", "x")])
def test_sentinels_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Sentinels(*marks)


def test_query_equals_its_sql(spark):
    same(spark, "op11_fill_in_middle")
