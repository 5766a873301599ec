"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import ngram_join as J

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < k:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


def plain_components(rows, percent=80):
    """{position: smallest id} and the number of links between different sets."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links += a != b
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)], links


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        step = rng.randrange(3)
        if step == 0:
            words[at] = f"e{rng.randrange(10**6)}"
        elif step == 1:
            words.insert(at, f"i{rng.randrange(10**6)}")
        elif len(words) > 2:
            del words[at]
    return words


def corpus(seed, families, members, shortest=3, longest=120):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, i = [], 0
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(shortest, longest))]
        if f % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.randrange(1, members)):
            rows.append((i, " ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 20))))))
            i += 1
    rng.shuffle(rows)
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, J.jaccard_components(df, **more).collect()), key=str)


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b C d", "a b c d e", "A b c d e F", "É é x Y z q \x1f w é", "the " * 40, "x\x0by z\x0cq r s"])
def test_sets_have_the_sizes_of_plain_ones(text):
    s = next(J.shingle_sets(pa.array([text])))
    assert len(s) == len(shingles(text)) and (np.diff(s.astype(object)) > 0).all()


def test_equal_sets_have_equal_hashes_in_any_batch():
    a = list(J.shingle_sets(pa.array(["q", "A b c d e f", "a b c d"])))
    b = list(J.shingle_sets(pa.array(["a B\n\nc  d e f", "", "A b c d "])))
    assert (a[1] == b[0]).all() and (a[2] == b[2]).all() and a[2][0] != a[1][0]


def test_bounds():
    for s in range(1, 80):
        for t in range(1, s + 1):
            least = next(i for i in range(1, 200) if 100 * i >= 80 * (s + t - i))
            assert J.needed(s, t, 80) == least
        assert J.prefix_length(s, 80) == s - -(-80 * s // 100) + 1
    assert J.subset_sizes(4, 24, 80) == [4] and J.subset_sizes(5, 24, 80) == [4, 5] and J.subset_sizes(5, 4, 80) == [4]
    assert J.boundary({n: 100 for n in range(1, 25)}, 50.0, 80) > J.boundary({n: 100 for n in range(1, 25)}, 0.1, 80) >= 1


@pytest.mark.parametrize("seed, families, members, shortest, longest", [(1, 40, 12, 3, 120), (2, 60, 10, 3, 18), (3, 4, 90, 60, 100)])
def test_components_equal_brute_force(spark, seed, families, members, shortest, longest):
    rows = corpus(seed, families, members, shortest, longest)
    want, links = plain_components(rows)
    assert links > 50
    assert got(spark, rows) == sorted(want, key=str)


@pytest.mark.parametrize("small", [0, 12])
def test_any_boundary_gives_the_same(spark, monkeypatch, small):
    rows = corpus(7, 50, 10, 6, 22)
    monkeypatch.setattr(J, "boundary", lambda *_: small)
    assert got(spark, rows) == sorted(plain_components(rows)[0], key=str)


def test_hot_shingles_single_comparisons_and_joins_of_texts(spark, monkeypatch):
    rows = corpus(9, 12, 40, 20, 60)
    want = sorted(plain_components(rows)[0], key=str)
    monkeypatch.setattr(J, "ROUNDS", 0)
    monkeypatch.setattr(J, "DEALT", 2)
    monkeypatch.setattr(J, "NAMES_BYTES", 1)
    assert got(spark, rows) == want
    monkeypatch.setattr(J, "HOT_SHINGLES", 10)
    assert got(spark, rows) == want


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 9973}" for i in range(40_000))
    rows = [(7, long), (3, long + " end"), (3, long), (None, long), (1, None), (2, ""), (4, " \n"), (None, None), (None, "only here with no id"), (None, "Only HERE with no id"),
            (9, "ab cd"), (8, "AB  cd"), (10, "ab cd x"), (11, "solo"), (12, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "cls": F.lit(1), "component_id": F.lit(0), "n_shingles": F.lit("y")})
    found = J.jaccard_components(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_components(rows)[0], key=str)


def test_empty_table_and_tables_without_links(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "a b c d e f"), (2, "u v w x y z"), (3, None)]) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_query_equals_brute_force_on_the_smallest_table(spark):
    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, links = plain_components(rows)
    assert links
    assert sorted(map(tuple, QUERIES["op13_ngram_jaccard_join"](spark, sf).collect()), key=str) == sorted(want, key=str)


def joined_rows(df):
    """Rows that each join makes when ``df`` is collected."""
    df.collect()
    nodes, rows = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            if "Join" in name:
                rows.append(node.metrics().apply("numOutputRows").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_left_over_sets_of_a_large_group_only_meet_where_they_may_link(spark, monkeypatch):
    rng = random.Random(5)
    base, members = [f"w{i}" for i in range(150)], 150
    rows = []
    for i in range(members):
        words = list(base)
        for at in rng.sample(range(5, 145), 3):
            words[at] = f"e{i}_{at}"
        rows.append((i, " ".join(words)))
    made, write = [], J.materialise_table
    inside = []

    def seen(df):
        if inside:
            made.extend(joined_rows(df))
        return write(df)

    def left_over(*args, step=J._left_over):
        inside.append(1)
        found = step(*args)
        inside.clear()
        return found

    monkeypatch.setattr(J, "ROUNDS", 0)
    monkeypatch.setattr(J, "boundary", lambda *_: 0)
    monkeypatch.setattr(J, "materialise_table", seen)
    monkeypatch.setattr(J, "_left_over", left_over)
    assert got(spark, rows) == sorted(plain_components(rows)[0], key=str)
    assert made and max(made) < members * members // 2


def test_a_list_with_a_larger_set_drops_no_class(spark, monkeypatch):
    passage = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join(passage + [f"{i}_{j}" for j in range(more)])) for i, more in enumerate([1, 3, 4])]  # 17, 19 and 20 shingles, 16 of them shared
    rows += [(i, " ".join([f"{i}_{j}" for j in range(200)] + passage)) for i in range(10, 40)]  # so that the shared ones come last
    monkeypatch.setattr(J, "boundary", lambda *_: 0)
    want, links = plain_components(rows)
    assert links == 1
    assert got(spark, rows) == sorted(want, key=str)


@pytest.mark.parametrize("percent", [51, 67, 80, 99, 100])
def test_what_any_partner_needs(spark, percent):
    def least(s, t):
        return 1 + J.needed(s, t, percent) + (-percent * max(s, t) // 100)

    rows = [(s, a, b, min(some)) for s in range(1, 45) for a in range(1, s + 1, 3) for b in range(s, 60, 4)
            if (some := [least(s, t) for t in range(max(a, -(-percent * s // 100)), min(b, 100 * s // percent) + 1)])]
    df = spark.createDataFrame(rows, "s long, a long, b long, n long")
    assert df.where(~J._enough_for_any(F.col("n"), F.col("s"), F.col("a"), F.col("b"), percent)).isEmpty()
