"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Merging by rank and left-to-right matching agree on this: a sequence of tokens is the encoding of its bytes exactly if
every two neighbours are compatible, that is, if merging the bytes of both yields these two again. So the encoder takes
the longest token at each position whose predecessor is compatible with it, and steps back where none is. A position
that was given up is never tried again, which keeps the time linear in the text. Matches come from an Aho-Corasick
automaton, whose alphabet is Latin-1: a byte is the character of the same number. Compatibility is remembered by pair.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import PieceEncoder

#: Pairs and pieces that a worker remembers; texts encoded at a time.
PAIRS, REMEMBERED, TEXTS_AT_ONCE = 1 << 19, 400_000, 512
#: Above all ranks: no merge.
NONE = 1 << 62
#: No byte, so that no token crosses it; and pieces that are split in one line.
DIVIDER, PIECES_AT_ONCE = "\u0100", 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: on each line a token in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(data: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The definition: merge the neighbours whose union has the lowest rank, the first of them, until no union has one.

    Stops early when ``until`` parts are left.
    """
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > until:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if rank == NONE:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[bytes, list[bytes]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            halves = merge_by_rank(token, ranks, 2)
            if len(halves) <= 2:  # others never come out of a merge
                self.halves[token] = halves
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = {ranks[token]: len(token) for token in self.halves}
        #: The longest other token that each token begins with.
        self.shorter = {ranks[t]: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.halves), None) for t in self.halves}

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end (-1: the last, 0: the first) of a token while it is merged, each with the rank of the
        merge that ends it."""
        out, ended = [], NONE
        while True:
            out.append((token, ended))
            if len(token) == 1:
                return out[::-1]
            ended, token = self.ranks[token], self.halves[token][side]

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether merging the bytes of two tokens never merges across their border. Merges go by rank; of equal ranks
        the first goes first, so that the border goes after the left token's own merge and before the right one's."""
        a, b, i, j = self._edge(left, -1), self._edge(right, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.ranks.get(x + y, NONE)
            if across < x_ends and across <= y_ends and across != NONE:
                return False
            if x_ends == y_ends == NONE:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(self.tokens[left], self.tokens[right])
        return known

    def encode(self, data: bytes) -> list[int]:
        """The ids of one match of the split pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, compatible = data.decode("latin-1"), self.compatible
        out = [token for _, token in self.automaton.iter_long(text)]  # the longest match at each place, one after another
        for i in range(1, len(out)):
            if not compatible(out[i - 1], out[i]):
                return self._backtrack(text, out[:i], out[i])
        return out

    def encode_many(self, matches: list[bytes]) -> list[list[int]]:
        """The ids of each of several matches. One pass of the automaton over all of them, divided by a sign that no token has."""
        out = [[whole] if (whole := self.ranks.get(m)) is not None else [] for m in matches]
        rest = [i for i, ids in enumerate(out) if not ids and matches[i]]
        if not rest:
            return out
        words = [matches[i].decode("latin-1") for i in rest]
        found = np.array(list(self.automaton.iter_long(DIVIDER.join(words))), np.int64)
        at = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1, found[:, 0], "right")
        tokens = found[:, 1]
        pairs, which = np.unique(tokens[:-1] << 32 | tokens[1:], return_inverse=True)
        same = at[1:] == at[:-1]
        used = np.zeros(len(pairs), bool)
        used[which[same]] = True
        fits = np.ones(len(pairs), bool)
        fits[used] = [self.compatible(p >> 32, p & 0xFFFFFFFF) for p in pairs[used].tolist()]
        wrong = np.flatnonzero(same & ~fits[which]) + 1
        begins = np.searchsorted(at, np.arange(len(words) + 1)).tolist()
        all_tokens = tokens.tolist()
        for k, i in enumerate(rest):
            out[i] = all_tokens[begins[k]:begins[k + 1]]
        words_wrong, first = np.unique(at[wrong], return_index=True)
        for k, j in zip(words_wrong.tolist(), (wrong[first]).tolist()):
            done = j - begins[k]
            ids = out[rest[k]]
            out[rest[k]] = self._backtrack(words[k], ids[:done], ids[done])
        return out

    def _backtrack(self, text: str, out: list[int], token: int | None) -> list[int]:
        """Go on from compatible tokens, and a candidate for the place behind them."""
        sizes, shorter, known, longest = self.sizes, self.shorter, self.pairs.get, self.automaton.iter_long
        n, at = len(text), sum([sizes[t] for t in out])
        given_up = bytearray(n + 1)
        last = out[-1] if out else -1
        while True:
            while token is not None:
                end = at + sizes[token]
                if not given_up[end]:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits if fits is not None else self.compatible(last, token):
                        break
                token = shorter[token]
            if token is None:
                given_up[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                continue
            out.append(token)
            if end == n:
                return out
            at, last = end, token
            for _, token in longest(text, at):
                break


@cache
def _piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """One for each worker, vocabulary file and pattern; kept from task to task."""
    encoder, split = Encoder(read_ranks(path)), regex.compile(pattern)

    def split_all(pieces: list[str]) -> list[list[str]]:
        """The matches of each piece. Pieces that begin with white space and end without are split in lines of many, where no match crosses."""
        out: list[list[str]] = [[]] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if p and p[0] in " \n" and not p[-1].isspace()]
        for i in set(range(len(pieces))).difference(joined):
            out[i] = split.findall(pieces[i])
        for at in range(0, len(joined), PIECES_AT_ONCE):
            some = joined[at:at + PIECES_AT_ONCE]
            matches = split.findall("".join([pieces[i] for i in some]))
            ends = np.searchsorted(np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches))), np.cumsum([len(pieces[i]) for i in some])) + 1
            start = 0
            for i, end in zip(some, ends.tolist()):
                out[i], start = matches[start:end], end
        return out

    def encode(pieces: list[str]) -> list[bytes]:
        cut = split_all(pieces)
        distinct = list(dict.fromkeys(m for c in cut for m in c))
        ids = dict(zip(distinct, encoder.encode_many([m.encode() for m in distinct])))
        return [array("I", [i for m in c for i in ids[m]]).tobytes() for c in cut]

    return PieceEncoder(encode, REMEMBERED)


@cache
def _token_bytes(path: str) -> pa.Array:
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def encode_column(text: str | Column, vocabulary: str, pattern: str) -> Column:
    """The ids of a text as array<int>. Every match of ``pattern`` is encoded by itself; there are no special tokens.

    The pattern must cut as byte-level BPE patterns do (see ``tokens``). Null texts count as empty and give an empty array.
    """

    @F.arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _piece_encoder(vocabulary, pattern)
        for texts in parts:
            ids: list[bytes] = []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                ids += encoder(texts.slice(at, TEXTS_AT_ONCE).to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))

    return encode(text_or_empty(text))


def decode_column(ids: str | Column, vocabulary: str) -> Column:
    """The bytes that the ids stand for. Null arrays give null; null and unknown ids are an error."""

    @F.arrow_udf("binary")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _token_bytes(vocabulary)
        for lists in parts:
            found = tokens.take(lists.flatten())
            if found.null_count:
                raise ValueError("an id is null or not in the vocabulary")
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), 0)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), found)
            yield pc.if_else(lists.is_valid(), pc.binary_join(rows, b""), pa.scalar(None, pa.binary()))

    return decode(ids)
