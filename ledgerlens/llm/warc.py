"""WARC archives: writing with revisit records, and a salvage reader.

Writing: payloads that occur more than once are found by digest (counts are combined before the shuffle), then one
join tells each row its response. Records are gzip members, gathered to archives of about ``ARCHIVE`` bytes and written
with Spark's own text writer, one archive a file, under its commit protocol: any file system that Spark writes to
will do, and lost tasks leave nothing behind. The writer ends each archive with a zero byte, which gzip readers pass over.

Reading: every record is checked (version line, headers, length, end, block digest, payload digest). After a failed
check the reader searches for the next gzip member or version line that holds a valid record, goes on from there, and
reports the bytes between as a quarantined gap with the reason. Members may hold any number of records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

ARCHIVE, FEED = 8 << 20, 1 << 14
#: Payloads below this many bytes are always written in full.
LEAST_SHARED = 100
#: Fixed values of WARC 1.1 and HTTP.
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
EOL, GZIP = b"\r\n", b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("archive string, offset long, length long, kind string, page_id long, uri string, payload binary, "
           "payload_bytes long, payload_digest string, refers_to long, reason string")


# ---------------------------------------------------------------- writing

def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: a response with HTTP headers and payload, or a revisit with the HTTP headers only."""
    http = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date,
            "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"), "WARC-Payload-Digest": f"sha256:{digest}",
            "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "WARC-Profile": SAME_PAYLOAD if revisit else None,
            "WARC-Refers-To": _record_id(refers_to, digest) if revisit else None, "Page-ID": page_id, "Refers-To-Page-ID": refers_to if revisit else None,
            "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in head.items() if v is not None]
    return EOL.join(lines) + EOL * 2 + block + EOL * 2


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _archives(date: str):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers, revisit = (batch.column(c)[i].as_py() for c in range(6))
                held.append(_gzip(record_bytes(page, url, payload, digest, refers, revisit, date)))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    return gather


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (payload: the text in UTF-8, null as empty) below ``path``.

    Of equal payloads of at least ``LEAST_SHARED`` bytes, the row with the smallest id becomes a response and the others
    revisits of it; rows that repeat that id are responses too, and so are all rows where every id is null. A null url or id leaves out its header.
    Other columns are not read. An empty table writes no archive.
    """
    payload = text_or_empty(payload_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = materialise(rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
                         .agg(F.min("page").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least"))
    revisit = F.coalesce(~F.col("page").eqNullSafe(F.col("least")) & F.col("least").isNotNull(), F.lit(False))
    ready = rows.join(shared, "digest", "left").select("page", "url", "payload", "digest", F.when(revisit, F.col("least")).alias("refers"), revisit.alias("revisit"))
    (ready.mapInArrow(_archives(date), "content binary").select(F.col("content").cast("string"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path))


# ---------------------------------------------------------------- reading

@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    end: int  # offset behind the record


@dataclass
class Damage(Exception):
    reason: str
    fields: dict = field(default_factory=dict)


def parse_record(data: bytes, at: int = 0) -> Record:
    """The record at ``at``; raises Damage if any check fails."""
    end = data.find(EOL * 2, at)
    if not data.startswith(VERSIONS, at):
        raise Damage("no version line")
    if end < 0:
        raise Damage("headers don't end")
    lines = data[at:end].split(EOL)
    if lines[0] not in VERSIONS:
        raise Damage("no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("malformed header")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damage("no content length")
    start = end + 4
    stop = start + int(length)
    if stop + 4 > len(data):
        raise Damage("block is cut off")
    if data[stop:stop + 4] != EOL * 2:
        raise Damage("block has another length")
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise Damage("block digest differs")
    if headers.get("warc-type") == "response":
        digest, body = headers.get("warc-payload-digest", ""), _payload(block)
        if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(body).hexdigest():
            raise Damage("payload digest differs")
    return Record(headers, block, stop + 4)


def _payload(block: bytes) -> bytes:
    head, gap, body = block.partition(EOL * 2)
    return body if gap and head.startswith(b"HTTP/") else block


def _http_length(block: bytes) -> int | None:
    for line in block.partition(EOL * 2)[0].split(EOL)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, the offset behind what was read of it, and what is wrong with it, if anything:
    then it is what it holds before the break."""
    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(data):
            parts.append(unpack.decompress(data[end:end + FEED]))
            end = min(end + FEED, len(data))
    except zlib.error:
        # the piece with the break again, byte by byte
        unpack = zlib.decompressobj(31)
        parts = [unpack.decompress(data[at:end])]
        try:
            for i in range(end, min(end + FEED, len(data))):
                parts.append(unpack.decompress(data[i:i + 1]))
        except zlib.error:
            pass
        return b"".join(parts), end, "gzip member is damaged"
    return b"".join(parts), end - len(unpack.unused_data), None if unpack.eof else "gzip member is cut off"


def _inside(plain: bytes) -> Iterator[Record | str]:
    """The valid records of a member, and a reason for each gap between, in order."""
    at = 0
    while at < len(plain):
        if plain[at] == 0:
            at += 1
            continue
        try:
            record = parse_record(plain, at)
            yield record
            at = record.end
            continue
        except Damage as damage:
            reason = damage.reason
        while at < len(plain):
            at = plain.find(b"WARC/1.", at + 1)
            at = len(plain) if at < 0 else at
            try:
                if at < len(plain):
                    parse_record(plain, at)
                break
            except Damage:
                continue
        yield reason


def _at(data: bytes, at: int) -> tuple[list[Record | str], int | None]:
    """The records at ``at`` (several, with reasons for gaps, if a member holds them) and the offset behind them; None if
    their member breaks off, with the reason as the last item. Raises Damage if there is no valid record."""
    if not data.startswith(GZIP, at):
        record = parse_record(data, at)
        return [record], record.end
    plain, end, broken = _unpacked(data, at)
    found = [*_inside(plain)]
    if not any(isinstance(x, Record) for x in found):
        raise Damage(broken or next(iter(found), "gzip member is empty"))
    if broken:  # the last gap, if there is one, is the break
        return [*(found[:-1] if isinstance(found[-1], str) else found), broken], None
    return found, end


def _next_start(data: bytes, at: int) -> int:
    """The next place from ``at`` on that looks like a member or a version line; the end if there is none."""
    places = [p for p in (data.find(GZIP, at), data.find(b"WARC/1.", at)) if p >= 0]
    return min(places, default=len(data))


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record) of all valid records and (offset, length, reason) of the gaps between, in order.

    Bytes of zero between records are padding and no gap. A valid record that lies inside a damaged one (in its
    payload, say) is recovered like any other. Records that share a gzip member, and the gaps between them, all have the
    place of the member; of a member that breaks off those before the break are read, and the rest is a gap. An empty
    archive has neither records nor gaps.
    """
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        start = at
        try:
            found, end = _at(data, at)
        except Damage as damage:
            found, end = [damage.reason], None
        while end is None and at < len(data):
            at = _next_start(data, at + 1)
            try:
                if at < len(data):
                    _at(data, at)
                break
            except Damage:
                continue
        at = at if end is None else end
        yield from ((start, at - start, x) for x in found)


def _reader(with_payload: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(),
                                                                   pa.int64(), pa.string(), pa.int64(), pa.string()))])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, held, path = [], 0, path.as_py()
                for offset, length, x in salvage(content.as_py()):
                    row = dict.fromkeys(names) | {"archive": path, "offset": offset, "length": length}
                    if isinstance(x, str):
                        row |= {"kind": "gap", "reason": x}
                    else:
                        h, kind = x.headers, x.headers.get("warc-type", "")
                        row |= {"kind": kind, "page_id": number(h.get("page-id")), "uri": h.get("warc-target-uri"), "refers_to": number(h.get("refers-to-page-id"))}
                        if kind == "revisit":
                            row |= {"payload_bytes": _http_length(x.block), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:")}
                        else:
                            body = _payload(x.block)
                            row |= {"payload": body if with_payload else None, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}
                    rows.append(row)
                    held += length if isinstance(x, str) else len(x.block)
                    if held > ARCHIVE or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record and each quarantined gap (kind ``gap``, with its reason) of the archives below ``path``.

    Responses carry their payload, its length and its digest as read. Revisits carry both as stated in their headers.
    Archives may be gzip members, plain records, or both in turn. No archive gives no rows.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(_reader(with_payload), RECORDS)
