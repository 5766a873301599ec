import random
import zlib

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ledgerlens.llm import langid as L

SYLLABLES = {"xa": ["kalo", "mita", "ruzo", "tani", "lumo"], "xb": ["sch", "ein", "unge", "keit", "ver"], "xc": ["eau", "oui", "ère", "tion", "ment"]}


def prose(lang, rng, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def corpus(n=240, seed=0):
    rng = random.Random(seed)
    langs = sorted(SYLLABLES)
    return [(i, prose(langs[i % 3], rng, rng.randrange(8, 120)), langs[i % 3]) for i in range(n)]


def test_planted_languages_nulls_repeats_and_clashing_columns(spark):
    rows = corpus()
    odd = [(900, None, "xa"), (901, "", "xa"), (902, "12 34 !?", "xb"), (903, "x", "xa"), (None, rows[0][1], "xa"), (904, rows[1][1], None), (5, rows[5][1], rows[5][2]), (905, rows[2][1] * 300, "xc")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit(9), "accepted": F.lit("a"), "id": F.lit(1), "n": F.lit(0)})
    known = L.learn(df)
    assert list(known) and set(known) == set(SYLLABLES)
    got = df.select("doc_id", "text", "lang", L.predict_column("text", known).alias("p")).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert tuple(r.p) == ("und", 0.0, False)
        elif r.doc_id != 903:
            assert r.p.accepted and 0 < r.p.score <= 1 and (r.lang is None or r.p.lang_pred == r.lang)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, _, _ in rows} | {904, 905, None}
    assert not {900, 901, 902} & {r.doc_id for r in kept.collect()}


def test_narrow_margin_is_rejected_and_shared_lines_are_not_learnt():
    known = {"xa": b"same words here " * 20, "xb": b"same words here " * 20}
    lang, margin, accepted = L.Classifier(known, 0.005).predict("Same words here")
    assert (lang, margin, accepted) == ("xa", 0.0, False)  # the first, most frequent one
    assert L.dictionary(["one line\nshared", "shared\nanother"], 1000) == b" one line\n another"


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    known = L.learn(df, per_language=4, chars=50, max_languages=2)
    assert len(known) == 2 and max(map(len, known.values())) <= 200


def test_copies_do_not_erase_each_other(spark):
    rows = corpus(120)
    hot = [(5000 + i, rows[0][1], "xa") for i in range(2000)]  # one text holds nearly all rows of its language
    df = spark.createDataFrame(rows + [(1000 + i, text, lang) for i, text, lang in rows] + hot, "doc_id long, text string, lang string")
    known = L.learn(df, chars=4096)
    assert all(known[lang].decode().count(text.lower()) == 1 for _, text, lang in rows)
    got = df.select("lang", L.predict_column("text", known).alias("p")).collect()
    assert all(r.p.lang_pred == r.lang and r.p.accepted for r in got)


def test_a_line_that_repeats_in_a_language_is_kept_once_and_one_of_several_languages_is_not(spark):
    rows = [(i, f"{text}\noften in {lang}\nin all languages", lang) for i, text, lang in corpus(30)]
    for lang, known in L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=4096).items():
        assert known.count(f"often in {lang}".encode()) == 1 and b"in all languages" not in known


def test_every_language_is_learnt(spark, monkeypatch):
    rng = random.Random(1)
    letters = [chr(0x4E00 + 40 * i + j) for i in range(70) for j in range(40)]
    rows = [(100 * i + j, "".join(rng.choices(letters[40 * i:40 * i + 40], k=200)), f"l{i}") for i in range(70) for j in range(9 if i < 64 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = L.learn(df)
    assert len(known) == 70 and all(r.p.lang_pred == r.lang for r in df.select("lang", L.predict_column("text", known).alias("p")).collect())
    monkeypatch.setattr(L, "SAMPLE", 140)
    known = L.learn(df, chars=100)
    assert len(known) == 70 and all(0 < len(d) <= 200 for d in known.values())
    monkeypatch.setattr(L, "SAMPLE", 69)
    with pytest.raises(ValueError, match="more than 69"):
        L.learn(df)


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.learn(empty) == {} and L.keep_identified(empty).count() == 0
    got = spark.createDataFrame([("words",)], "text string").select(L.predict_column("text", {}).alias("p")).first().p
    assert tuple(got) == ("und", 0.0, False)


def test_query_learns_from_rows_that_are_not_held_out_and_is_right_on_the_others(spark):
    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in rows} <= {d.lang for d in docs.values()} and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("text", ["a", "é", "漢", " a ", "A" * 5000])
def test_short_and_long_texts_do_not_fail(text):
    known = {"xa": b"abc", "xb": b""}
    lang, score, _ = L.Classifier(known, 0.005).predict(text)
    assert lang in known and 0 <= score <= 1


def plain_dictionaries(docs, per_language=128, chars=1024):
    """Learning without Spark: every labelled text, sorted by its hash."""
    texts = {}
    for r in docs:
        if r.doc_id is not None and r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            texts.setdefault(r.lang, []).append(r.text)
    langs = sorted(texts, key=lambda x: (-len(texts[x]), x))
    parts = {}
    for lang in langs:
        hashed = sorted({(h % (1 << 40), h if h < 1 << 63 else h - (1 << 64), t) for t in texts[lang] for h in [xxhash.xxh64_intdigest(t.encode(), 42)]})
        some = sorted(hashed[:min(per_language, 8192 // len(langs))], key=lambda x: x[1])
        parts[lang] = [t[max(0, (len(t) - chars) // 2):][:chars] for _, _, t in some]
    owners = {}
    for lang, own in parts.items():
        for line in {x for t in own for x in t.split("\n")}:
            owners.setdefault(line, set()).add(lang)
    out = {}
    for lang, own in parts.items():
        lines = list(dict.fromkeys(x for t in own for x in t.split("\n")))
        out[lang] = "\n".join(" " + x.lower() for x in lines if len(owners[x]) == 1).encode()[:len(own) and min(per_language, 8192 // len(langs)) * chars]
    return out


def plain_prediction(text, known):
    """One compression of each block with each language's dictionary."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, sizes = (" " + text.lower()).encode(), {}
    for lang, content in known.items():
        def size(block):
            d = zstandard.ZstdCompressionDict(content + b" " * max(0, 8 - len(content)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=5)
            return len(zstandard.ZstdCompressor(level=5, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))
        blocks = [data[i:i + 1024] for i in range(0, len(data), 1024)]
        sizes[lang] = max(1, size(content[-400:] + blocks[0]) - size(content[-400:]) + sum(map(size, blocks[1:])))
    best = min(sizes, key=sizes.get)
    return best, 1 - sizes[best] / min(n for lang, n in sizes.items() if lang != best)


def test_query_equals_brute_force_on_the_smallest_table(spark):
    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    known = plain_dictionaries(docs)
    got = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in QUERIES["op9_language_id"](spark, sf).collect()}
    assert len(known) > 1 and got == {r.doc_id: (p, round(s, 12)) for r in docs for p, s in [plain_prediction(r.text, known)]}
