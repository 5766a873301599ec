import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc as W

from .oracle import same


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_query_equals_sql(spark):
    same(spark, "op7_warc")


def record(n, payload=None, revisit=False):
    payload = f"<p>page {n}</p>".encode() * 5 if payload is None else payload
    return W.record_bytes(n, f"http://x/{n}", payload, sha(payload), 1 if revisit else None, revisit, "2024-01-01T00:00:00Z")


def pages(data):
    return [int(x.headers["page-id"]) for _, _, x in W.salvage(data) if not isinstance(x, str)]


def gaps(data):
    return [(at, n) for at, n, x in W.salvage(data) if isinstance(x, str)]


@pytest.mark.parametrize("pack", [lambda r: r, W._gzip])
def test_salvage_of_every_kind_of_damage(pack):
    parts = [pack(record(n)) for n in range(6)]
    whole = b"".join(parts)
    assert pages(whole) == list(range(6)) and gaps(whole) == []
    starts = [sum(map(len, parts[:n])) for n in range(7)]
    flipped = bytearray(whole)
    flipped[starts[2] + len(parts[2]) // 2] ^= 0x55
    assert pages(bytes(flipped)) == [0, 1, 3, 4, 5] and gaps(bytes(flipped)) == [(starts[2], len(parts[2]))]
    cut = whole[:starts[3] + 9] + whole[starts[4]:]
    assert pages(cut) == [0, 1, 2, 4, 5] and gaps(cut) == [(starts[3], 9)]
    junk = b"\x1f\x8b\x08 WARC/1.1 junk" + whole[:starts[1]] + b"WARC/1.1\r\nno colon\r\n\r\n" + whole[starts[1]:] + b"tail"
    assert pages(junk) == list(range(6)) and len(gaps(junk)) == 3
    ended = whole[:-10]
    assert pages(ended) == list(range(5)) and gaps(ended) == [(starts[5], len(parts[5]) - 10)]
    assert pages(whole[:starts[1]] + b"\0" * 20 + whole[starts[1]:]) == list(range(6))


def test_members_that_hold_several_records():
    rng = random.Random(3)
    records = [record(n, rng.randbytes(3000)) for n in range(40)]
    whole, tail = W._gzip(b"".join(records)), W._gzip(record(90))
    assert pages(whole + tail) == [*range(40), 90] and gaps(whole + tail) == []
    inner = records.copy()
    inner[7] = inner[7][:-1000] + b"x" + inner[7][-999:]
    spoilt = W._gzip(b"".join(inner))
    assert pages(spoilt + tail) == [*range(7), *range(8, 40), 90] and gaps(spoilt + tail) == [(0, len(spoilt))]
    cut = whole[:len(whole) // 2]  # half of random bytes are half of the records
    assert pages(cut + tail)[:18] == [*range(18)] and pages(cut + tail)[-1] == 90 and gaps(cut + tail) == [(0, len(cut))]
    assert pages(cut) == pages(cut + tail)[:-1]
    broken = bytearray(whole)
    broken[len(whole) // 2:len(whole) // 2 + 400] = b"\xff" * 400
    assert pages(bytes(broken) + tail)[:18] == [*range(18)] and pages(bytes(broken) + tail)[-1] == 90 and gaps(bytes(broken) + tail) == [(0, len(broken))]
    no_sum = whole[:-8] + bytes(8)
    assert pages(no_sum) == [*range(40)] and gaps(no_sum) == [(0, len(no_sum))]


def test_gaps_and_records_cover_the_archive():
    rng = random.Random(0)
    whole = b"".join(rng.choice([lambda r: r, W._gzip])(record(n, rng.randbytes(rng.randrange(0, 300)))) for n in range(30))
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            data[at:at + rng.randrange(1, 40)] = rng.randbytes(rng.randrange(0, 40))
        at = 0
        for start, size, _ in W.salvage(bytes(data)):
            assert not any(data[at:start]) and size > 0
            at = start + size
        assert not any(data[at:]) and len(pages(bytes(data))) >= 15


def test_payload_that_holds_a_record_is_one_record():
    inner = record(1)
    data = record(2, inner) + record(3, b"WARC/1.1\r\n\r\n")
    assert pages(data) == [2, 3]


def test_written_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE", 300)
    big = "é" * 60
    rows = [(4, "http://a/ b\r\nX: y", big), (2, None, big), (2, "http://c", big), (9, "d", "short"), (3, "e", "short"), (None, "f", None), (8, "g", ""), (None, "h", big),
            (None, "i", "n" * 200), (None, "j", "n" * 200), (1, "k", "\0" * 150 + "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "least": F.lit(1), "payload": F.lit("p")})
    path = str(tmp_path / "w")
    W.write_archives(df, path)
    got = W.read_archives(spark, path).collect()
    assert all(r.kind in ("response", "revisit") for r in got)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        revisit = (t == big and i != 2)
        want.append((i, "revisit" if revisit else "response", len(data), sha(data), 2 if revisit else None, None if revisit else data))
    assert sorted(((r.page_id, r.kind, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 1
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in files)  # any gzip reader takes the archives
    assert plain.count(b"WARC/1.1\r\nWARC-Type") == len(rows)


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).count() == 0
