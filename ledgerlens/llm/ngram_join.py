"""N-gram Jaccard self-join: a size-aware heavy-light join of the sets of word shingles.

Two sets of s and t shingles link at a Jaccard similarity of ``percent`` / 100 or more, that is, if they share at least
c(s, t) = ceil(percent * (s + t) / (100 + percent)) shingles. Equal sets are one class, which takes part once.

* Small sets enumerate their subsets of c shingles, for each c that a partner's size may ask for. Sets that meet at a subset
  share c shingles, so no check is left: each is linked to the smallest set at that subset, if c is enough for both. That
  set is linked to all that are linked there at all, as c(s, t) grows with the size.
* Large sets scan inverted lists, those of the rarest shingles: in a common order, two sets that link share one of the first
  s - ceil(percent * s / 100) + 1 shingles of each. A list holds the large sets, and the small ones that are large enough
  to be partners of large ones. The order is by frequency, so that passages shared by very many texts come last.
* The boundary between small and large is the one with the least cost: subsets of the small sets, against the scanned
  entries of the large ones, from the sizes of all sets and the lengths of all lists.

Frequencies are counted over all texts. Shingles move as sorted blocks of 4 bytes each, cut by range of the hash; a shingle that a task
sees often is one entry of its block. The most frequent ones, at most ``HOT_SHINGLES``, are told to all tasks. Lists of other shingles are shorter than
the frequency from which on a shingle counts as hot, and are made in blocks; lists of hot shingles stay rows and are never held by a task.
Lists with the same members are one list.

Candidates come from lists. In a round, every set is compared with one set of its lists, one that has much in common with many (another from round to
round); sets found to be linked are one component, and lists of one component are done. After ``ROUNDS`` rounds, or as soon as few pairs are left, the sets
that are not in their list's largest component meet others of the list that are in another component. They only meet where both have enough lists left, in an
order from short lists to long ones, to link if this is the first they share; pairs that then meet in too few lists to link drop out (``_left_over``), the others are compared. So no link between components is lost, and copies of one text are not compared pair by pair. Compared sets are made again from the texts, which move once for each comparison;
the comparisons of a set with very many others are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small, estimated_bytes
from .common import NAMES_BYTES, materialise_table, numbered, text_or_empty
from .components import connected_components
from .words import parts

#: Shingles that a task holds before it writes blocks; bytes of input for a block range; ranges at most; bytes of text that are hashed at a time.
HELD, RANGE_BYTES, MOST_RANGES, BLOCK_BYTES = 1 << 21, 1 << 21, 1 << 16, 1 << 20
#: A shingle is hot from this frequency on, or a greater one that leaves so many hot ones at most.
HOT_FREQUENCY, HOT_SHINGLES = 16, 1 << 19
#: The largest set that may count as small; rounds of single comparisons, and pairs for each list
#: entry that end them; comparisons of one set in a task.
LARGEST_SMALL, ROUNDS, FEW, DEALT = 24, 4, 8, 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


# ---------------------------------------------------------------- sets

def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    return h ^ (h >> np.uint64(32))


#: White space; and a value for each byte, where A-Z count as a-z.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = _stirred(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_VALUE[65:91] = _VALUE[97:123]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    def of(base: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)
    return of(_BASE), of(_INVERSE)


def _word_hashes(data: np.ndarray, white: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``data`` (bytes), and how many words lie before each of ``cuts`` (0, ..., length), which no word crosses.

    A word's hash is a polynomial in its bytes, taken from sums over all bytes: no step is done for a single word.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    full = ~white
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    starts = np.flatnonzero(full & (edge[:-1] | np.concatenate(([True], white[:-1]))))
    ends = np.flatnonzero(full & (edge[1:] | np.concatenate((white[1:], [True])))) + 1
    power, inverse = _powers(max(BLOCK_BYTES, 1 << int(len(data) - 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[:len(data)], dtype=np.uint64)))
    return _stirred((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD[3]), np.searchsorted(starts, cuts)


def _blocks(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_word_hashes`` in blocks that stay small for any length of text, cut at white space."""
    white = _WHITE[data]
    if len(data) <= BLOCK_BYTES:
        yield _word_hashes(data, white, cuts)
        return
    hashes, before, at = [], np.zeros(len(cuts), np.int64), 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not white[end]:
            gap = np.flatnonzero(white[end:end + BLOCK_BYTES])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + BLOCK_BYTES)
        inside = (cuts > at) & (cuts <= end)
        own = np.concatenate(([0], cuts[inside] - at, [end - at]))
        h, n = _word_hashes(data[at:end], white[at:end], own)
        before[inside] += n[1:-1]
        before[cuts > end] += len(h)
        hashes.append(h)
        at = end
    yield np.concatenate(hashes), before


def shingle_sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text its different shingles, as sorted 64-bit hashes. A-Z count as a-z. Fewer words are one shingle; none, none."""
    factors = _ODD[np.arange(words) % len(_ODD)] * (np.uint64(2) * np.arange(words, dtype=np.uint64) + np.uint64(1))
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    for first, n in parts(texts, BLOCK_BYTES):
        part = texts.slice(first, n)
        _, places, content = part.buffers()
        cuts = np.frombuffer(places, np.int64)[part.offset:part.offset + n + 1]
        data = np.frombuffer(content, np.uint8)[cuts[0]:cuts[-1]] if content else np.empty(0, np.uint8)
        for v, ends in _blocks(data, cuts - cuts[0]):
            h = np.zeros(max(0, len(v) - words + 1), np.uint64)
            for j in range(words):
                h += v[j:j + len(h)] * factors[j]
            h = _stirred(h)
            ends = ends.tolist()
            for a, b in zip(ends[:-1], ends[1:]):
                if b - a >= words:
                    s = np.sort(h[a:b - words + 1])
                    yield s[np.concatenate(([True], s[1:] != s[:-1]))]
                elif b > a:
                    yield _stirred((v[a:b] * factors[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
                else:
                    yield np.empty(0, np.uint64)


def _class(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), len(s))


def needed(s: int, t: int, percent: int) -> int:
    """Shingles that sets of s and t must share."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(s: int, percent: int) -> int:
    return s + (-percent * s // 100) + 1


def subset_sizes(s: int, most: int, percent: int) -> list[int]:
    """The sizes of the subsets that a small set enumerates, where small sets have ``most`` shingles or fewer."""
    return sorted({c for t in range(-(-percent * s // 100), min(most, 100 * s // percent) + 1) if t and (c := needed(s, t, percent)) <= min(s, t)})


# ---------------------------------------------------------------- frequencies

def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _ranges(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, whose low 32 bits are the place within their range."""
    which = keys >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
    for a, b in zip(first.tolist(), np.append(first[1:], len(keys)).tolist()):
        yield int(which[a]), a, b


def _low(keys: np.ndarray) -> bytes:
    return (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


COUNTED = "range long, kind int, key long, n long, once binary, more binary, times binary"


def _counter(words: int, bits: int):
    """Blocks of shingles (kind 0), and the sets of each size (kind 1)."""
    def flush(held: list[np.ndarray], sizes: dict[int, int]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        rows = []
        if len(keys):
            for r, a, b in _ranges(keys):
                one = n[a:b] == 1
                rows.append((r, 0, 0, 0, _low(keys[a:b][one]), _low(keys[a:b][~one]), n[a:b][~one].astype("<u4").tobytes()))
        rows += [(s % (1 << bits), 1, s, k, None, None, None) for s, k in sizes.items()]
        yield _batch(rows, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["range", "kind", "key", "n", "once", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size, sizes = set(), [], 0, {}
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                if not len(s) or (c := _class(s)) in seen:
                    continue
                seen.add(c)
                held.append(s)
                sizes[len(s)] = sizes.get(len(s), 0) + 1
                size += len(s)
                if size >= HELD:
                    yield from flush(held, sizes)
                    held, size, sizes = [], 0, {}
        yield from flush(held, sizes)

    return run


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _by_range(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[int | None, list[dict], pa.RecordBatch | None]]:
    """(range, its rows of that kind, None), and (None, [], other rows); rows come sorted by range."""
    now, held = None, []
    for batch in batches:
        mine = pc.equal(batch.column("kind"), kind)
        rest = batch.filter(pc.invert(mine))
        if rest.num_rows:
            yield None, [], rest
        for row in batch.filter(mine).to_pylist():
            if held and row["range"] != now:
                yield now, held, None
                held = []
            now = row["range"]
            held.append(row)
    if held:
        yield now, held, None


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): frequent shingles (0), sets of a size (1), entries (2) and the sum of squared frequencies of the others (3)."""
    for r, rows, rest in _by_range(batches, 0):
        if rest is not None:
            yield rest.select(["kind", "key", "n"])
            continue
        once = np.concatenate([np.frombuffer(x["once"], "<u4") for x in rows])
        more = np.concatenate([np.frombuffer(x["more"], "<u4") for x in rows])
        keys = np.concatenate((once, more))
        times = np.concatenate([np.ones(len(once), np.int64)] + [np.frombuffer(x["times"], "<u4").astype(np.int64) for x in rows])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n, keys = np.add.reduceat(times, first), keys[first]
        hot = n >= HOT_FREQUENCY
        full = (np.uint64(r) << np.uint64(32)) | keys[hot].astype(np.uint64)
        out = [(0, k, c) for k, c in zip(_signed(full).tolist(), n[hot].tolist())] + [(2, 0, int(n[~hot].sum())), (3, 0, int((n[~hot] ** 2).sum()))]
        yield _batch(out, [pa.int32(), pa.int64(), pa.int64()], ["kind", "key", "n"])


def boundary(sizes: dict[int, int], scanned: float, percent: int) -> int:
    """The largest size that counts as small, at the least cost; ``scanned`` are the entries scanned for each of a large set's."""
    def cost(most: int) -> float:
        subsets = sum(n * sum(comb(s, c) for c in subset_sizes(s, most, percent)) for s, n in sizes.items() if s <= most)
        partners = sum(n * prefix_length(s, percent) for s, n in sizes.items() if s <= most and 100 * s >= percent * (most + 1))
        return subsets + partners + sum(n * prefix_length(s, percent) * (1 + scanned) for s, n in sizes.items() if most < s <= LARGEST_SMALL)
    return min(range(LARGEST_SMALL + 1), key=cost)


def frequencies(docs: DataFrame, text_col: str, words: int, percent: int, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hot keys, their frequencies, the largest size of a small set)."""
    blocks = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_counter(words, bits), COUNTED)
    found = materialise_table(blocks.repartition("range").sortWithinPartitions("range").mapInArrow(_frequent, "kind int, key long, n long"))
    steps = {r["k"]: r["n"] for r in found.where("kind = 0").groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least = HOT_FREQUENCY.bit_length() - 1
    while sum(n for k, n in steps.items() if k >= least) > HOT_SHINGLES:
        least += 1
    sums = {(r["kind"], r["key"]): r["n"] for r in found.where("kind > 0").groupBy("kind", F.least("key", F.lit(LARGEST_SMALL + 1)).alias("key")).agg(F.sum("n").alias("n")).collect()}
    scanned = sums.get((3, 0), 0) / max(1, sums.get((2, 0), 0))
    hot = found.where((F.col("kind") == 0) & (F.col("n") >= 1 << least)).select("key", "n").toArrow()
    keys, n = hot["key"].to_numpy().astype(np.int64).view(np.uint64), hot["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], boundary({s: n for (kind, s), n in sums.items() if kind == 1 and s <= LARGEST_SMALL}, scanned, percent)


# ---------------------------------------------------------------- lists

DOC, BLOCK, HOT, SUBSET, LISTED = range(5)
OWN, NAMES = ["id", "file", "at"], ["kind", "range", "key", "cls", "size", "blob"]


def _lister(words: int, percent: int, bits: int, small: int, hot):
    """Rows of documents, blocks of list entries, entries of hot shingles, and subsets of small sets."""
    def flush(held: list[tuple[np.ndarray, int, int]]) -> Iterator[tuple]:
        each = [len(k) for k, _, _ in held]
        keys = np.concatenate([k for k, _, _ in held])
        cls = np.repeat(np.array([c for _, c, _ in held], np.uint64), each)
        size = np.repeat(np.array([s for _, _, s in held], np.uint32), each)
        order = np.argsort(keys, kind="stable")
        keys, cls, size = keys[order], cls[order], size[order]
        for r, a, b in _ranges(keys):
            yield BLOCK, r, b - a, None, None, _low(keys[a:b]) + cls[a:b].astype("<u8").tobytes() + size[a:b].astype("<u4").tobytes()

    def out(docs: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        rest = _batch(rows, types, NAMES)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, pa.nulls(len(rows) - len(a), a.type)]) for a in docs] + rest.columns, [*OWN, *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_n = hot.value
        seen, held, entries, at, nothing = set(), [], 0, 0, None
        for batch in batches:
            docs, rows, nothing = [], [], [c.slice(0, 0) for c in batch.columns[:3]]
            for s in shingle_sets(batch.column(3), words):
                at += 1
                c = _class(s) if len(s) else None
                docs.append((DOC, at % (1 << bits), None, None if c is None else _long(c), len(s), None))
                if c is None or c in seen:
                    continue
                seen.add(c)
                if len(s) <= small:
                    for k in subset_sizes(len(s), small, percent):
                        for part in combinations(s.tolist(), k):
                            key = _key(sum(part), k)
                            rows.append((SUBSET, key >> (64 - bits), _long(key), _long(c), len(s) << 8 | k, None))
                    if 100 * len(s) < percent * (small + 1):
                        continue
                n = prefix_length(len(s), percent)
                keys = s >> np.uint64(32 - bits)
                often = np.zeros(len(s), np.int64)
                if len(hot_keys):
                    place = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                    often = np.where(hot_keys[place] == keys, hot_n[place], 0)
                first = np.argsort(often, kind="stable")[:n] if often.any() else np.arange(n)
                rare, warm = keys[first[often[first] == 0]], keys[first[often[first] > 0]]
                if len(rare):
                    held.append((rare, c, len(s)))
                    entries += len(rare)
                rows += [(HOT, (at + i) % (1 << bits), k, _long(c), len(s), None) for i, k in enumerate(_signed(warm).tolist())]
                if entries >= HELD // 2:
                    rows += flush(held)
                    held, entries = [], 0
            yield out(batch.columns[:3], docs + rows)
        if held:
            yield out(nothing, list(flush(held)))

    return run


def _key(total: int, k: int) -> int:
    return int(_stirred(np.array([(total + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks become the entries (key, cls, size, n) of lists with more than one class; a list's key is a hash of its classes, ``n`` the shingles that have it."""
    names = [*OWN, "kind", "key", "cls", "size"]
    own_types: list[pa.DataType] = []

    def watched() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_types[:] = [batch.column(c).type for c in OWN]
            yield batch

    for _, rows, rest in _by_range(watched(), BLOCK):
        if rest is not None:
            yield rest.select(names).append_column("n", pa.nulls(rest.num_rows, pa.int64()))
            continue
        low, cls, size = [], [], []
        for row in rows:
            n = row["key"]
            low.append(np.frombuffer(row["blob"], "<u4", n))
            cls.append(np.frombuffer(row["blob"], "<u8", n, 4 * n))
            size.append(np.frombuffer(row["blob"], "<u4", n, 12 * n))
        low, cls, size = map(np.concatenate, (low, cls, size))
        order = np.argsort(low, kind="stable")
        low = low[order]
        same = low[1:] == low[:-1]
        some = np.concatenate((same, [False])) | np.concatenate(([False], same))  # shingles of one entry drop out
        low, order = low[some], order[some]
        cls, size = cls[order], size[order]
        order = np.lexsort((cls, low))
        low, cls, size = low[order], cls[order], size[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (cls[1:] != cls[:-1])))[:len(low)]
        low, cls, size = low[new], cls[new], size[new]
        if not len(low):
            continue
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        n = np.diff(np.append(first, len(low)))
        key = _stirred(np.add.reduceat(_stirred(cls ^ _ODD[3]), first) + n.astype(np.uint64))
        _, one, times = np.unique(key, return_index=True, return_counts=True)
        equal = np.zeros(len(first), np.int64)  # shingles of equal lists, told by the first of them
        equal[one] = times
        kept = np.repeat((equal > 0) & (n > 1), n)
        m = int(kept.sum())
        if m:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, t) for t in own_types], pa.array(np.full(m, LISTED, np.int32)), pa.array(_signed(np.repeat(key, n)[kept])),
                                              pa.array(_signed(cls[kept])), pa.array(size[kept].astype(np.int64)), pa.array(np.repeat(equal, n)[kept])], [*names, "n"])


def _hot_lists(entries: DataFrame) -> DataFrame:
    """The lists of hot shingles: (key, cls, size, n), with the key of equal lists."""
    entries = materialise_table(entries.distinct())
    made = materialise_table(entries.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(cls))").alias("x"), F.expr("bit_xor(xxhash64(cls, 7))").alias("y")))
    named = entries.join(made.where("n > 1"), "key").select(F.xxhash64("n", "x", "y").alias("key"), "cls", "size")
    return named.groupBy("key", "cls", "size").agg(F.count("*").alias("n"))


def _subset_links(subsets: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) around the smallest set of each subset."""
    subsets = materialise_table(subsets.select("key", "cls", F.expr("size >> 8").alias("size"), F.expr("size & 255").alias("shared")).distinct())
    centres = materialise_table(subsets.groupBy("key").agg(F.min(F.struct("size", "cls")).alias("centre"), F.count("*").alias("n")).where("n > 1"))
    return (subsets.join(centres, "key").where(F.col("cls") != F.col("centre.cls"))
            .where(F.col("shared") * (100 + percent) >= percent * (F.col("size") + F.col("centre.size")))
            .select(F.col("cls").alias("a"), F.col("centre.cls").alias("b")).distinct())


# ---------------------------------------------------------------- comparisons

def _comparer(words: int, percent: int):
    """Rows come sorted by centre and part, the centre's own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            a, b = [], []
            for c, member, s in zip(batch.column("centre").to_pylist(), batch.column("cls").to_pylist(), shingle_sets(batch.column("text"), words)):
                if member == c:
                    centre, own = c, s
                elif centre == c:
                    shared = len(own) + len(s) - len(np.union1d(own, s))
                    if shared >= needed(len(own), len(s), percent):
                        a.append(c)
                        b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link. A centre a with very many partners is compared in several tasks."""
    dealt = materialise_table(pairs.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("cls"), F.floor(F.col("n") / DEALT).alias("last")))
    members = pairs.join(broadcast_if_small(dealt.withColumnRenamed("cls", "a")), "a").select(F.col("a").alias("centre"), F.col("b").alias("cls"), F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("part"))
    centres = dealt.select(F.col("cls").alias("centre"), "cls", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    rows = texts.join(broadcast_if_small(materialise_table(members.union(centres))), "cls")
    return (rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("cls") != F.col("centre"))
            .select("centre", "cls", "text").mapInArrow(_comparer(words, percent), "a long, b long"))


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (cls, root) after the links (a, b): each root takes the smallest one it is linked to, or that one's."""
    small = labels.select(F.col("cls").alias("a"), F.col("root").alias("x")), labels.select(F.col("cls").alias("b"), F.col("root").alias("y"))
    step = found.join(small[0], "a").join(small[1], "b").where("x <> y").groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("to"))
    step = materialise_table(step)
    step = step.join(step.select(F.col("root").alias("to"), F.col("to").alias("further")), "to", "left").select("root", F.coalesce("further", "to").alias("to"))
    return materialise_table(labels.join(broadcast_if_small(materialise_table(step)), "root", "left").select("cls", F.coalesce("to", "root").alias("root")))


def _enough(n: Column, s: Column, t: Column, percent: int) -> Column:
    """Whether sets of s and t shingles that have n listed ones in common may link.

    Say the listed part of one, p of its s shingles, ends first in the common order. It holds all shared ones up to there, that is p less
    those that only this set has, which are s - c(s, t) at most; and the other's part holds them too.
    """
    c, outside = F.ceil(percent * (s + t) / (100 + percent)), F.ceil(percent * F.greatest(s, t) / 100)
    return n >= 1 + c - outside


def _enough_for_any(n: Column, s: Column, least: Column, most: Column, percent: int) -> Column:
    """Whether a set of s shingles that has n listed ones in common with one of ``least`` to ``most`` may link with it.

    What it needs is least at either end of the sizes that can link; towards the upper one, rounding may leave one less than there.
    """
    lower, upper = F.greatest(least, F.ceil(percent * s / 100)), F.least(most, F.floor(100 * s / percent))
    return _enough(n, s, lower, percent) | _enough(n + 1, s, upper, percent)


def _candidates(entries: DataFrame, seed: int, may_link: Callable[[Column, Column], Column], percent: int) -> DataFrame:
    """For each class one other (a, b), of another component: the first in an order that is the first of enough of its lists.

    The order is one for all lists, so that most classes of a large group of copies meet the same one: by weight, so that this is one that has
    most in common with the others; after the first round weights are lowered by a hash, by half at most.
    """
    less = F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1 << 20)) / float(1 << 21) if seed else F.lit(0.0)
    h = -F.col("weight") * (1 - less)
    first = materialise_table(entries.groupBy("key").agg(F.min(F.struct(h.alias("h"), F.col("cls").alias("a"), F.col("size").alias("a_size"), F.col("root").alias("a_root"))).alias("c")))
    met = entries.join(broadcast_if_small(first), "key").where((F.col("root") != F.col("c.a_root")) & may_link(F.col("size"), F.col("c.a_size")))
    shared = met.groupBy(F.col("cls").alias("b"), "size", "c").agg(F.sum("n").alias("n")).where(_enough(F.col("n"), F.col("size"), F.col("c.a_size"), percent))
    return materialise_table(shared.groupBy("b").agg(F.min("c").alias("c")).select("c.a", "b"))


def _weighed(entries: DataFrame, percent: int) -> DataFrame:
    """``entries`` with ``weight``: how often a class meets others in its lists. Without those that can't link to any of their list.

    A class has no more in common with another than the shingles of all its lists.
    """
    lists = materialise_table(entries.groupBy("key").agg(F.count("*").alias("held"), F.min("size").alias("least"), F.max("size").alias("most")))
    classes = entries.join(broadcast_if_small(lists.select("key", "held")), "key").groupBy("cls").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("held")).cast("double").alias("weight"))
    may = _enough_for_any(F.col("total"), F.col("size"), F.col("least"), F.col("most"), percent)
    known = entries.join(broadcast_if_small(lists), "key").join(broadcast_if_small(materialise_table(classes)), "cls")
    return materialise_table(known.where(may).select("key", "cls", "size", "n", "weight"))


def _open(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The entries of lists of several components, with ``root`` and the largest component ``main``; and the pairs still to be looked at, at most."""
    named = materialise_table(entries.select("key", "cls", "size", "n", "weight").join(broadcast_if_small(labels), "cls"))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("held"))
    main = materialise_table(sizes.groupBy("key").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.max("held").alias("most"), F.sum("held").alias("all")).where("most < all"))
    left = main.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("n")).first()["n"]
    return materialise_table(named.join(broadcast_if_small(main.select("key", "main")), "key")), left or 0


def _left_over(entries: DataFrame, may_link: Callable[[Column, Column], Column], percent: int) -> DataFrame:
    """All pairs (a, b) of different components that may link, unless both are of the largest component of each of their lists.

    In one order of all lists, short ones first, what two sets share lies at or behind the first list that holds both. So they meet in that list though
    a meeting is only looked at if either set still has enough shingles in its lists from there on (``rest``). In a large group of copies
    the long lists come last, where few have enough left. What is shared is then counted once for each pair.
    """
    lists = materialise_table(entries.groupBy("key").agg(F.count("*").alias("held"), F.min("size").alias("least"), F.max("size").alias("most")))
    rest = F.sum("n").over(Window.partitionBy("cls").orderBy(F.desc("held"), F.desc("key")))
    ranked = entries.join(broadcast_if_small(lists), "key").withColumn("rest", rest)
    ranked = materialise_table(ranked.where(_enough_for_any(F.col("rest"), F.col("size"), F.col("least"), F.col("most"), percent)).select("key", "cls", "size", "root", "main", "rest"))
    a = ranked.where("root <> main").select("key", F.col("cls").alias("a"), F.col("size").alias("a_size"), F.col("root").alias("a_root"), F.col("rest").alias("a_rest"))
    met = a.join(ranked, "key").where((F.col("root") != F.col("a_root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("cls"))) & may_link(F.col("size"), F.col("a_size"))
                                      & _enough(F.least("rest", "a_rest"), F.col("size"), F.col("a_size"), percent))
    pairs = materialise_table(met.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b"), F.least("size", "a_size").alias("s"), F.greatest("size", "a_size").alias("t")).distinct())
    classes = materialise_table(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    held = entries.join(broadcast_if_small(classes), "cls").groupBy("cls").agg(F.collect_list(F.concat_ws(":", "key", "n")).alias("lists"))
    held = broadcast_if_small(materialise_table(held))
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("lists").alias("a_lists")), "a").join(held.select(F.col("cls").alias("b"), F.col("lists").alias("b_lists")), "b")
    n = F.aggregate(F.array_intersect("a_lists", "b_lists"), F.lit(0).cast("long"), lambda n, x: n + F.substring_index(x, ":", -1).cast("long"))
    return materialise_table(both.where(_enough(n, F.col("s"), F.col("t"), percent)).select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles`` (size of its set) and ``component_id``.

    ``component_id`` is the smallest id of all documents that are reachable over links. A-Z count as a-z; a text with fewer
    than ``words`` words is one shingle; a null text, or one without words, has none and is linked with nothing, so that its own id
    is its component. Rows with a null id keep their row and take the component's smallest id (null if it has none). Repeated
    rows are kept. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is 51 to 100")
    spark = docs.sparkSession
    source = numbered(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))).select("rec.id", "row.file", "row.at", "rec.text")
    bits = max(6, min(MOST_RANGES, estimated_bytes(docs) // RANGE_BYTES).bit_length())
    hot_keys, hot_n, small = frequencies(source, "text", words, percent, bits)
    hot = spark.sparkContext.broadcast((hot_keys, hot_n))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, file long, at long, kind int, key long, cls long, size long, n long"
    listed = source.mapInArrow(_lister(words, percent, bits, small, hot), f"id {id_type}, file long, at long, kind int, range long, key long, cls long, size long, blob binary")
    made = materialise_table(listed.repartition("range").sortWithinPartitions("range").mapInArrow(_lists, schema))

    def may_link(s: Column, t: Column) -> Column:
        return (F.greatest(s, t) > small) & (100 * F.least(s, t) >= percent * F.greatest(s, t))

    links = [materialise_table(_subset_links(made.where(F.col("kind") == SUBSET), percent))]
    rare = made.where(F.col("kind") == LISTED).groupBy("key", "cls", "size").agg(F.sum("n").alias("n"))
    entries = materialise_table(rare.union(_hot_lists(made.where(F.col("kind") == HOT).select("key", "cls", "size"))))
    classes = materialise_table(entries.select("cls").distinct())
    texts = _texts(source, made.where(F.col("kind") == DOC).join(broadcast_if_small(classes), "cls"))
    labels = _relabelled(classes.select("cls", F.col("cls").alias("root")), links[0])
    entries, left = _open(_weighed(entries, percent), labels)
    before = [left] * 3
    for seed in range(ROUNDS):
        if left <= FEW * entries.count() or 10 * left > 9 * before[-3] and seed > 2:
            break
        before.append(left)
        links.append(materialise_table(_compared(_candidates(entries, seed, may_link, percent), texts, words, percent)))
        labels = _relabelled(labels, links[-1])
        entries, left = _open(entries, labels)
    links.append(_compared(_left_over(entries, may_link, percent), texts, words, percent))
    roots = connected_components(reduce(DataFrame.union, links)).withColumnRenamed("node", "cls")

    rows = made.where(F.col("kind") == DOC).select("id", "cls", "size")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("own")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    classes = materialise_table(classes)
    least = materialise_table(classes.groupBy("root").agg(F.min("own").alias("component_id")))
    classes = materialise_table(classes.join(least, "root").select("cls", "component_id"))
    return rows.join(classes, "cls", "left").select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                                                    F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _texts(source: DataFrame, named: DataFrame) -> DataFrame:
    """(cls, text) of one row of each class; rows are found by name. Texts stay where they are read as long as the names are few."""
    names = materialise_table(named.groupBy("cls").agg(F.min(F.struct("file", "at")).alias("row")).select("cls", "row.file", "row.at"))
    return materialise_table(source.select("file", "at", "text").join(broadcast_if_small(names, NAMES_BYTES), ["file", "at"]).select("cls", "text"))
