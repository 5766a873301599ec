"""Packing of tokenised documents into sequences: best-fit decreasing, certified by lower bounds, with repacking.

Documents are tokenised, and those longer than a sequence are cut: full pieces are sequences of their own, what is
left over (the first piece) is packed with the short documents. Items are dealt into groups of about ``GROUP``; each
group is packed best fit decreasing. Dual feasible functions bound the sequences that a group's items need at least:
a group that needs no more is certified, and gives only its emptiest sequence away. A group with a gap keeps its full
sequences and gives the others away; if it came in sequences and saved none, it keeps the fuller half of these too. What
was given away is dealt into fewer groups, whose documents are packed anew, and the better of the old and the new packing
stays. This ends when one group holds all that was given away, or when the sequences of all groups are as few as the
bound for the lengths of the whole table. A group never holds more than a bounded number of rows; the driver reads counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, materialise_table, text_or_empty
from .tokens import PieceEncoder

#: Items in a group; texts of an Arrow batch that are turned into rows at a time; pieces that are encoded in one line.
GROUP, TEXTS_AT_ONCE, PIECES_AT_ONCE = 32_768, 512, 1024


# ---------------------------------------------------------------- tokens

@cache
def _encoder(path: str) -> PieceEncoder:
    """One for each worker and vocabulary file; kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of each token: the vocabulary writes a byte as a character
    for token, i in tokenizer.get_vocab().items():
        sizes[i] = len(token)

    def ids(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(pieces: list[str]) -> list[bytes]:
        """Pieces that begin with white space and end without are encoded in lines of many, where no token joins two."""
        out: list[bytes] = [b""] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if p and p[0] in " \n" and not p[-1].isspace()]
        for i in set(range(len(pieces))).difference(joined):
            out[i] = ids(pieces[i]).tobytes()
        for at in range(0, len(joined), PIECES_AT_ONCE):
            line = [pieces[i] for i in joined[at:at + PIECES_AT_ONCE]]
            found = ids("".join(line))
            ends = np.searchsorted(np.cumsum(sizes[found]), np.cumsum([len(p.encode()) for p in line])) + 1
            data, start = found.tobytes(), 0
            for i, end in zip(joined[at:at + PIECES_AT_ONCE], ends.tolist()):
                out[i], start = data[4 * start:4 * end], end
        return out

    return PieceEncoder(encode)


def _cuts(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of n ids: only the first piece may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    yield 0, 0, first
    for piece, start in enumerate(range(first, n, capacity), 1):
        yield piece, start, capacity


def tokenise(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece of each document: id, piece, start, length and ``ids`` (little-endian unsigned 32-bit).

    Null texts count as empty: their one piece is the end id. Null and repeated ids keep their rows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows: list[tuple[int, int, int, int, bytes]] = []
                for i, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids += end
                    rows += [(i, p, s, n, ids[4 * s:4 * (s + n)]) for p, s, n in _cuts(len(ids) // 4, capacity)]
                which, piece, start, length, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                                  pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- one group

def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that they have left
    some, n = 0, 0  # bit r: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - left
        left -= need
        room[left].append(b)
        some |= 1 << left
    return bins, offsets, n


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """At least so many bins are needed for ``counts[x]`` items of length x, by dual feasible functions."""
    x = np.arange(capacity + 1)
    best = int(-(-(counts * x).sum() // capacity))
    for e in range(1, capacity // 2 + 1):  # large items fill a bin, small ones count as nothing
        f = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, int(-(-(counts * f).sum() // capacity)))
    for k in range(1, 33):  # rounding to multiples of 1 / (k + 1)
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-(counts * f).sum() // (capacity * k))))
    return best


def _pack(capacity: int, round_no: int):
    """A function that packs one group, or keeps the sequences it came in if that is no worse.

    Adds sequence_id, offset, ``done``, and says by ``certified`` whether the bound was met.
    """
    def pack(rows: pa.Table) -> pa.Table:
        lengths, old = rows["length"].to_numpy(), rows["sequence_id"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        before = len(np.unique(old)) if round_no else n + 1
        saved = n < before
        if saved:
            sequence = (round_no << 54) + (int(rows["group"][0].as_py()) << 20) + bins
        else:
            sequence, offsets, n = old, rows["offset"].to_numpy(), before
            bins = np.unique(old, return_inverse=True)[1]
        certified = n == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths)
        emptiest = np.argsort(fill, kind="stable")[:np.count_nonzero(fill < capacity)]
        # a group that saved nothing gives fewer away than came in, so that the exchange comes to an end
        away = len(emptiest) if saved else len(emptiest) // 2
        done = np.ones(n, bool)
        done[emptiest[:min(away, 1) if certified else away]] = False
        new = {"sequence_id": sequence, "offset": offsets, "done": done[bins], "certified": np.full(len(bins), certified)}
        return pa.table({name: pa.array(new[name]) if name in new else rows[name] for name in rows.column_names})

    return pack


# ---------------------------------------------------------------- all groups

def _dealt(rows: DataFrame, n: int, round_no: int) -> DataFrame:
    """Whole sequences are dealt to groups, each round anew."""
    return rows.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(max(1, -(-n // GROUP)))))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The rows of ``pieces`` (any columns, among them ``length``, 1 to ``capacity``) with ``sequence_id``, ``offset`` and
    ``certified``: whether the bounds prove that the group it was packed in can't do with fewer sequences.

    Sequences are numbered by any different numbers; a sequence's pieces lie one after another from offset 0. Full
    pieces are sequences of their own. Null ids, repeated rows and equal lengths are packed like any other.
    Columns named like the added ones are replaced. An empty table gives no rows.
    """
    added = ["group", "sequence_id", "offset", "done", "certified"]
    rec = [c for c in pieces.columns if c not in added]
    rows = materialise(pieces.select(F.struct(*rec).alias("rec"), "length", F.monotonically_increasing_id().alias("sequence_id")))
    number = F.col("sequence_id") + F.lit(1 << 62)
    finished = [rows.where(F.col("length") >= capacity).select("rec", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    now = rows.where(F.col("length") < capacity).withColumns({"offset": F.lit(0).cast("long"), "done": F.lit(False), "certified": F.lit(False)})
    counts = np.zeros(capacity + 1, np.int64)
    for r in now.groupBy("length").count().collect():  # a row for each length
        counts[r["length"]] = r["count"]
    n, kept, least, round_no = int(counts.sum()), 0, lower_bound(counts, capacity), 0
    while n:
        grouped = _dealt(now, n, round_no)
        # the rows are few words each: ids and lengths, no tokens
        packed = materialise(grouped.groupBy("group").applyInArrow(_pack(capacity, round_no), grouped.schema).drop("group"))
        finished.append(packed.where("done").select("rec", "sequence_id", "offset", "certified"))
        now = packed.where("not done")
        groups = max(1, -(-n // GROUP))
        after = packed.agg(F.count_distinct("sequence_id").alias("all"), F.count_distinct(F.when(~F.col("done"), F.col("sequence_id"))).alias("open"),
                           F.count_if(~F.col("done")).alias("n")).first()
        if groups == 1 or kept + after["all"] == least:
            finished.append(now.select("rec", "sequence_id", "offset", "certified"))
            break
        n, kept, round_no = after["n"], kept + after["all"] - after["open"], round_no + 1
    out = finished[0]
    for part in finished[1:]:
        out = out.union(part)
    return out.select("rec.*", "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack: a row for each piece with ``ids_crc32`` and its place (see ``tokenise`` and ``pack``)."""
    pieces = tokenise(docs, vocabulary, id_col, text_col, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity)


def sequences(pieces: DataFrame, packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences themselves: sequence_id, length and ``ids`` of all its pieces in order (little-endian, as given).

    ``pieces`` are rows of ``tokenise`` and ``packed`` their places; id and piece identify a row of both.
    """
    parts = packed.select(id_col, "piece", "sequence_id", "offset").join(pieces.select(id_col, "piece", "length", "ids"), [id_col, "piece"])
    whole = parts.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
