"""Periodic runs of words, by a suffix automaton whose suffix links are kept in a link-cut forest.

A run is a stretch of words with smallest period q, of at least ``times`` periods, that no neighbour extends. The automaton takes the words one by
one. In its tree of suffix links, every state stands for suffixes, and its colour is the place where these ended last.
Appending word i recolours the path from its state to the root: an access of the link-cut forest, whose
path segments are stretches of one colour. A segment of colour j, entered at a state of length m, says that the words that end at i and at j
agree on m words and no more. So the distance d = i - j is a period of the m + d words that end at i, and these can't be extended to the left. If m >= d they
hold a square, and d is their smallest period: a smaller one would have put a later colour on that segment. The last i at which a stretch is seen
is its right end. Every run of two periods or more is seen so at each place from its first square to its end, as the root of a square
is not found within the square again. Segments change in amortised logarithmic number, so that n words take n log n steps or so.

Only words that can lie in a run are appended. Within a run of four periods and six words, any three neighbouring words occur three times. So
stretches whose every three neighbours occur three times are taken out first, by counting over all words of a batch, and each stretch
gets an automaton of its own. No run crosses the end of a stretch, nor could a word beyond extend it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .words import Words, joined, parts, split

#: A run's periods and words, at least; how often three neighbouring words of it occur then.
TIMES, LEAST, OCCUR = 4, 6, 3
RUN = "struct<start:long,length:long,period:long>"


def segment_runs(codes: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``codes`` with ``length >= max(least, times * period)``; ``times`` is 2 at least."""
    # automaton: state 0 is none, 1 the root
    link, length, after = [0, 0], [0, 0], [{}, {}]
    # forest: splay trees over path segments, shallower states left; the colour is held by each tree's top
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]
    seen: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            colour[x] = colour[p]

    last = 1
    for i, w in enumerate(codes):
        now = len(link)
        length.append(length[last] + 1)
        p = last
        while p and w not in (out := after[p]):
            out[w] = now
            p = link[p]
        q = 1
        if p:
            q = after[p][w]
            if length[p] + 1 != length[q]:
                copy = now + 1
                splay(q)  # the copy takes its place above q, in q's segment
                b = left[q]
                link += [copy, link[q]]
                length.append(length[p] + 1)
                after += [{}, after[q].copy()]
                left += [0, b]
                right += [0, 0]
                up += [copy, q]
                colour += [-1, -1]
                if b:
                    up[b] = copy
                left[q] = link[q] = copy
                while p and after[p].get(w) == q:
                    after[p][w] = copy
                    p = link[p]
                q = 0
        if q:
            link.append(q)
            after.append({})
            left.append(0)
            right.append(0)
            up.append(q)
            colour.append(-1)
        # access: the path from the new state to the root gets colour i
        below, x = now, up[now]
        while x:
            splay(x)
            j, m = colour[x], length[x]
            d = i - j
            if m >= (times - 1) * d and m + d >= least:
                seen[i - d - m + 1, d] = i
            if right[x]:
                colour[right[x]] = j
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
        splay(now)
        last = now
    return sorted((s, e - s + 1, d) for (s, d), e in seen.items())


def _stretches(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches that can hold runs: each three neighbours occur ``OCCUR`` times in their stretch."""
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    codes = codes.astype(np.uint64)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(codes) > 2 else np.empty(0, np.int64)  # where three begin
    part = owner[at].astype(np.uint64)
    exact, before = False, -1
    while len(at):
        key = codes[at] * mix[0] + codes[at + 1] * mix[1] + codes[at + 2] * mix[2] + part * mix[3]
        if exact:
            _, which, n = np.unique(key, return_inverse=True, return_counts=True)
            often = n[which] >= OCCUR
        else:  # keys that share a slot are counted together, so that too many stay
            bits = max(10, int(4 * len(key)).bit_length())
            slot = (key >> np.uint64(64 - bits)).astype(np.int64)
            often = np.bincount(slot, minlength=1 << bits)[slot] >= OCCUR
        at, part = at[often], part[often]
        if not len(at):
            break
        new = np.concatenate(([True], (np.diff(at) != 1) | (part[1:] != part[:-1])))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        long = np.repeat(sizes + 2 >= LEAST, sizes)
        at, part = at[long], np.cumsum(new).astype(np.uint64)[long]
        if exact and len(at) == before:
            break
        exact, before = True, len(at)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return at[first], at[np.append(first[1:], len(at)) - 1] + 3


def find_runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows (text, start, length, period), by text, start and period; and which words are left without repeated periods."""
    kept, found = np.ones(len(words.codes), bool), []
    for a, b in zip(*map(np.ndarray.tolist, _stretches(words.codes, words.owner))):
        text = int(np.searchsorted(words.ends, a, "right")) - 1
        base = int(words.ends[text])
        for s, n, q in segment_runs(words.codes[a:b].tolist()):
            found.append((text, a - base + s, n, q))
            kept[a + s + q:a + s + n] = False
    return np.array(found, np.int64).reshape(-1, 4), kept


def runs_column(text: str | Column) -> Column:
    """struct<runs: array of (start, length, period) by start and period, collapsed: string> of each text.

    ``collapsed`` joins by one space the words that no run holds after its first period. Null texts, and texts without
    words, have no runs and an empty ``collapsed``. A text's automaton is held by one task and grows with its longest repetitive stretch.
    """

    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            runs, counts, collapsed = [], [], []
            for first, n in parts(texts):
                words = split(texts.slice(first, n))
                found, kept = find_runs(words)
                runs.append(found)
                counts.append(np.bincount(found[:, 0], minlength=n))
                collapsed.append(joined(words, None if kept.all() else kept))
            rows = np.concatenate(runs) if runs else np.empty((0, 4), np.int64)
            ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.array([0])
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), structs)
            yield pa.StructArray.from_arrays([lists, pa.concat_arrays(collapsed) if collapsed else pa.array([], pa.string())], ["runs", "collapsed"])

    return of(text_or_empty(text))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``runs`` and ``collapsed`` (see ``runs_column``).

    Null and repeated ids keep their rows. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    return docs.select(F.col(id_col), runs_column(text_col).alias("_found")).select(id_col, "_found.*")


def strongest(runs: str | Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null if there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
