"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes of the text's word
shingles. Two fingerprints at distance d <= r have a common point at most ceil(r / 2) flips from one and
floor(r / 2) from the other, so that comparing the balls around all fingerprints for equal points finds
every pair. Three things keep this linear and small:

* Only different fingerprints take part, once each, however many documents have them.
* With a = floor(r / 2), every fingerprint emits its ball of radius a. Pairs at distance r = 2a + 1 need
  one side's flips of a + 1 bits as well. Their parities differ, and a + 1 of the differing bits lie in the
  same half of the word: it suffices that even fingerprints flip a + 1 bits of the high half and odd ones
  a + 1 bits of the low half (496 variants instead of 2016 where r is 3).
* The shuffle goes by the half of a variant that the wide flips leave alone. Variants that agree on it
  travel as one row, (route, fingerprint), and the task expands the other half. About 50 rows a fingerprint
  are shuffled instead of 561.

A point's group holds different fingerprints near that point, which bounds it by the ball's size. A member
within a of the point is within r of all others: the smallest such member is paired with each (a star, not
all pairs), every pair is verified by its bit distance, and repeated pairs are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, materialise_table, numbered, text_or_empty, without
from .components import connected_components

HALF = 32
LOW = (1 << HALF) - 1
#: Text bytes and shuffled rows that a task works on at a time; and variants that it compares at a time.
TEXT_BLOCK, ROUTE_BLOCK, VARIANT_BLOCK = 1 << 20, 1 << 15, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- fingerprints

def _shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[list[int]]:
    """Hashes of all word shingles, in blocks that stay small for any length of text."""
    words: list[bytes] = []
    digest, at, some = xxhash.xxh64_intdigest, 0, False
    while at < len(text):
        cut = _SPACE.search(text, at + TEXT_BLOCK)
        end = cut.start() if cut else len(text)
        words = words + text[at:end].lower().split()  # bytes: A-Z only, and exactly that white space
        at = end
        if len(words) >= shingle:
            line, some = b" ".join(words), True
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            yield [digest(line[i:j], seed) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
            words = words[len(words) - shingle + 1:]
    if words and not some:
        yield [digest(b" ".join(words), seed)]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no word."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text, shingle, seed):
        block = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        total += len(block)
        for at in range(0, len(block), 255):  # sums of 255 bits fit a byte
            ones += np.unpackbits(block[at:at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little") if total else 0


def fingerprint_column(text: str | Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long; null text counts as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of(text_or_empty(text).cast("binary"))


# ---------------------------------------------------------------- links

@lru_cache(maxsize=64)
def _flips(first: int, least: int, most: int) -> np.ndarray:
    """All masks of ``least`` to ``most`` bits among the 32 that start at bit ``first``."""
    return np.array([sum(1 << (first + i) for i in c) for n in range(least, most + 1) for c in combinations(range(HALF), n)], np.uint64)


def _routes(fingerprints: DataFrame, distance: int) -> DataFrame:
    """Rows (side, route, fp). Side 0 goes by the low half, side 1 (odd distances only) by the high half."""
    near = distance // 2
    masks = [int(m) for m in _flips(0, 0, near)]
    ball, own = F.array(*[F.lit(m) for m in masks]), F.array(F.lit(0))
    low, high = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", HALF)
    sides = [fingerprints.select(F.lit(0).alias("side"), low.alias("half"), "fp", F.explode(ball).alias("mask"))]
    if distance % 2:
        odd = F.bit_count("fp") % 2 == 1  # odd ones bring only their wide flips to side 1
        sides.append(fingerprints.select(F.lit(1).alias("side"), high.alias("half"), "fp",
                                         F.explode(F.when(odd, own).otherwise(ball)).alias("mask")))
    out = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    return out.select("side", F.col("half").bitwiseXOR(F.col("mask")).alias("route"), "fp")


def _variants(side: int, route: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of one side: (variants, their row, whether the row's fingerprint is within the small radius)."""
    near, wide = distance // 2, distance % 2
    first = HALF if side == 0 else 0  # of the half that is expanded here
    kept = fp & np.uint64(LOW << first)
    moved = kept | (route << np.uint64(HALF - first))
    away = np.bitwise_count(fp ^ moved)
    odd = np.bitwise_count(fp) % 2 == 1
    for n in range(near + 1):
        rows = np.flatnonzero((away == n) & (~odd if side else True))
        masks = _flips(first, 0, near - n)
        if len(rows):
            yield (moved[rows, None] ^ masks).ravel(), np.repeat(rows, len(masks)), np.ones(len(rows) * len(masks), bool)
    if wide:
        rows = np.flatnonzero((away == 0) & (odd if side else ~odd))
        masks = _flips(first, near + 1, near + 1)
        if len(rows):
            yield (fp[rows, None] ^ masks).ravel(), np.repeat(rows, len(masks)), np.zeros(len(rows) * len(masks), bool)


def _stars(points: np.ndarray, members: np.ndarray, central: np.ndarray, distance: int) -> np.ndarray:
    """Verified pairs (smaller, larger) of fingerprints that meet at a point, as rows of two."""
    order = np.argsort(points, kind="stable")
    points = points[order]
    same = points[1:] == points[:-1]
    shared = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    if not len(shared):
        return np.empty((0, 2), np.uint64)
    points, members, central = points[shared], members[order[shared]], central[order[shared]]
    starts = np.flatnonzero(np.concatenate(([True], points[1:] != points[:-1])))
    last = np.uint64(2**64 - 1)
    centre = np.minimum.reduceat(np.where(central, members, last), starts)
    found = np.logical_or.reduceat(central, starts)
    sizes = np.diff(np.append(starts, len(points)))
    centre, found = np.repeat(centre, sizes), np.repeat(found, sizes)
    hit = found & (centre != members) & (np.bitwise_count(centre ^ members) <= distance)
    pairs = np.stack((np.minimum(centre[hit], members[hit]), np.maximum(centre[hit], members[hit])), axis=1)
    return np.unique(pairs, axis=0)


def _match(side: int, route: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Pairs among rows of whole routes. A large block is compared in passes over slices of the variants."""
    masks = sum(len(_flips(0, 0, distance // 2 - n)) for n in range(distance // 2 + 1)) + (len(_flips(0, distance // 2 + 1, distance // 2 + 1)) if distance % 2 else 0)
    per_row = max(1, VARIANT_BLOCK // masks)
    passes = 1
    while passes * VARIANT_BLOCK < len(fp) * masks // 16 and passes < 1 << 16:  # most rows stand for one variant
        passes *= 2
    for k in range(passes):
        found = []
        for at in range(0, len(fp), per_row):
            for points, rows, central in _variants(side, route[at:at + per_row], fp[at:at + per_row], distance):
                members = fp[at:at + per_row][rows]
                if passes > 1:
                    mine = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)) % np.uint64(passes) == np.uint64(k)
                    points, members, central = points[mine], members[mine], central[mine]
                found.append((points, members, central))
        yield _stars(*(np.concatenate(x) for x in zip(*found)), distance)


def _matcher(distance: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows come sorted by side and route; blocks end where a route ends."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1))
            if sum(map(len, held)) >= ROUTE_BLOCK:
                rows = np.concatenate(held)
                cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))
                if len(cut):
                    yield rows[: cut[-1] + 1]
                    rows = rows[cut[-1] + 1:]
                held = [rows]
        if held:
            yield np.concatenate(held)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            for side in (0, 1):
                mine = rows[rows[:, 0] == side]
                if len(mine) > 1:
                    for pairs in _match(side, mine[:, 1].astype(np.uint64), np.ascontiguousarray(mine[:, 2]).view(np.uint64), distance):
                        if len(pairs):
                            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    return match


def fingerprint_links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Columns ``a``, ``b``: pairs of different fingerprints at ``distance`` bits or fewer.

    ``fingerprints`` has a column ``fp`` (long); repeats and nulls are dropped. Every two fingerprints within
    the distance are linked by these pairs, directly or over a third one that is within it of both.
    """
    if not 0 <= distance <= 7:
        raise ValueError("distance is 0 to 7")
    routes = _routes(fingerprints.select("fp").where("fp is not null").distinct(), distance)
    return (routes.repartition("side", "route").sortWithinPartitions("side", "route")
            .mapInArrow(_matcher(distance), "a long, b long").distinct())


def _with_first(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` (id, fp, row) with ``first``: (none, id, row) of the first row of its component, null ids last.

    The answers, one for each fingerprint, are checkpointed: both sides of the join are then plain exchanges, and
    the engine can split the rows of a fingerprint that very many documents have.
    """
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("own"))
    roots = connected_components(fingerprint_links(prints, distance)).withColumnRenamed("node", "fp")
    first = materialise(roots.join(nodes, "fp").groupBy("root").agg(F.min("own").alias("first")))
    linked = roots.join(first, "root").select("fp", "first")
    answers = materialise(nodes.join(linked, "fp", "left").select("fp", F.coalesce("first", "own").alias("first")))
    return prints.join(answers, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: its id, ``fp`` (long) and ``component_id``.

    ``component_id`` is the smallest id of all documents reachable over links of ``distance`` bits or fewer.
    Null texts count as empty; texts without a word have fingerprint 0 and are linked like any other. Rows
    with a null id keep their row and take the component's smallest id (null if it has none). Repeated rows
    are kept. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    prints = materialise(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp"), F.monotonically_increasing_id().alias("row")))
    return _with_first(prints, distance).select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies, with its columns: of each component the row with the smallest id.

    Exactly one row stays, also where the id repeats (any of these) or all ids are null. Only names, ids and fingerprints of rows are
    written and moved; the rows that go are taken out by name.
    """
    rows = numbered(docs)
    rec = F.col("rec")
    prints = materialise_table(rows.select(rec[id_col].alias("id"), fingerprint_column(rec[text_col], shingle).alias("fp"), "row"))
    return without(rows, _with_first(prints, distance).where("row <> first.row"))


def fingerprint_hex(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
