"""Encoders against the libraries whose ids they have to give, over fuzzed and planted texts."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, packing, tokens

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", "the", "é", "ß", " ", " ", "  ", "\n", "\t", "　", " ", "\x1c", "\x85", ".", ",", "'s", "'", "_", "1", "٣", "漢", "🙂", "\r", "\0", "\x0b",
            "​", "́", "<|endoftext|>", "e", "!", ", ", ". ", ".\n"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def fuzzed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 25))) for _ in range(n)]


HARD = ["a" * 5000, "ab" * 3000, "x" + "eé" * 2000, " " * 3000, "\n" * 50 + " x", "".join(random.Random(1).choices("abcdefgh", k=9000)), "aaaa aaaaa aaaaaa", "", " "]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_bpe_equals_the_library(library):
    encode = bpe._piece_encoder(MULTI, P.PATTERN)
    texts = fuzzed(6000, 1) + HARD
    assert [ids(x) for x in encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_single_matches_with_few_remembered_pairs(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 50)
    encoder, rng = bpe.Encoder(bpe.read_ranks(MULTI)), random.Random(2)
    for _ in range(400):
        word = "".join(rng.choices("abcdeinrstéßx", k=rng.randrange(1, 60)))
        assert encoder.encode(word.encode()) == library.encode_ordinary(word)


def test_compatible_pairs_are_those_that_merging_keeps():
    ranks = bpe.read_ranks(MULTI)
    encoder, rng, names = bpe.Encoder(ranks), random.Random(3), {r: t for t, r in ranks.items()}
    some = rng.sample(sorted(ranks[t] for t in encoder.halves), 400)
    for a in some[:200]:
        for b in rng.sample(some, 20):
            assert encoder.compatible(a, b) == (bpe.merge_by_rank(names[a] + names[b], ranks) == [names[a], names[b]])


def test_texts_longer_than_a_block_and_bounded_memory(library, monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BLOCK", 50)
    monkeypatch.setattr(tokens, "LONGEST", 4)
    encode = tokens.PieceEncoder(lambda ps: [np.array(library.encode_ordinary(p), "<u4").tobytes() for p in ps], 20)
    texts = ["".join(x) for x in zip(fuzzed(300, 4), fuzzed(300, 5), fuzzed(300, 6), fuzzed(300, 7))] + HARD
    assert [ids(x) for x in encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert max(map(len, encode._known)) <= 4


def test_ids_for_packing_equal_the_tokenizers_library():
    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = fuzzed(3000, 8) + HARD
    assert [ids(x) for x in packing._encoder(path)(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_and_decode_columns(spark, library):
    texts = [None, "", "hot hot"] + fuzzed(300, 9) + ["word " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("ids", F.lit("mine"))
    coded = df.select("doc_id", bpe.encode_column("text", MULTI, P.PATTERN).alias("x")).select("*", bpe.decode_column("x", MULTI).alias("back"))
    got = {r.doc_id: (r.x, bytes(r.back)) for r in coded.collect()}
    assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    nulls = spark.createDataFrame([(None,), ([],)], "x array<int>").select(bpe.decode_column("x", MULTI).alias("b"))
    assert [r.b and bytes(r.b) for r in nulls.collect()] in ([None, b""], [b"", None])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert df.select(bpe.encode_column("text", MULTI, P.PATTERN)).count() == 0


def test_query_equals_the_library_on_the_smallest_table(spark, library):
    import hashlib

    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_byte_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = library.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert not got
