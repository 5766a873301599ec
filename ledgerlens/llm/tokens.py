"""Cutting text where no token can cross, and remembering what each piece was encoded to.

The split patterns of byte-level BPE vocabularies never match from a non-space character into white space. A text may
therefore be cut before each run of white space that follows another character, and its pieces be encoded one by one.
Arrow cuts the texts and numbers the different pieces, a worker looks each of these up, and the ids of all texts are gathered by
number: no Python code runs for a single word. Remembered pieces are short and their number is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts only before a space or line feed, which are white space by any definition; other white space stays inside.
_PIECES = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
_CUT = re.compile(r"\S(?=[ \n])")
_MARK = "\0"
#: Texts that are cut by ``_PIECES``; and those whose commas and full stops may belong to a longer run of such signs.
_UNUSUAL = re.compile(r"\s\s|\A\s|\s\Z|\0")
_SIGNS = re.compile(r"(?:\W|_)[,.]")
#: The same two for Arrow, where classes are those of ASCII: any white space, and anything but letters and numbers.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_UNUSUAL_ARROW, _SIGNS_ARROW = rf"{_BLANK}{_BLANK}|\A{_BLANK}|{_BLANK}\z|\x00", r"[^\p{L}\p{N}][,.]"
#: Characters cut up at a time, pieces that a worker remembers, and characters of a remembered piece.
TEXT_BLOCK, REMEMBERED, LONGEST = 1 << 21, 500_000, 48


def pieces(text: str) -> list[str]:
    """The text cut where no token crosses: before white space, and around a comma or full stop that ends a word."""
    if _UNUSUAL.search(text):
        return _PIECES.findall(text)
    marked = text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n")
    if not _SIGNS.search(text):
        marked = marked.replace("," + _MARK, f"{_MARK},{_MARK}").replace("." + _MARK, f"{_MARK}.{_MARK}")
    return marked.split(_MARK)


def blocks(text: str) -> Iterator[str]:
    """The text in parts of about TEXT_BLOCK characters, cut where no token crosses."""
    at = 0
    while len(text) - at > TEXT_BLOCK and (m := _CUT.search(text, at + TEXT_BLOCK)):
        yield text[at:m.end()]
        at = m.end()
    yield text[at:]


def cut_all(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of all texts, text after text; the order in which the texts come, and each one's number of pieces in that order."""
    array = pa.array(texts, pa.large_string())
    unusual = pc.match_substring_regex(array, _UNUSUAL_ARROW).to_numpy(zero_copy_only=False)
    signs = pc.match_substring_regex(array, _SIGNS_ARROW).to_numpy(zero_copy_only=False)
    flat, order, counts = [], [], []
    for rows, apart in ((np.flatnonzero(~unusual & ~signs), True), (np.flatnonzero(~unusual & signs), False)):
        if len(rows):
            marked = array.take(pa.array(rows))
            for sign in " \n":
                marked = pc.replace_substring(marked, sign, _MARK + sign)
            for sign in ",." if apart else "":
                marked = pc.replace_substring(marked, sign + _MARK, f"{_MARK}{sign}{_MARK}")
            lists = pc.split_pattern(marked, _MARK)
            flat.append(lists.flatten())
            counts.append(pc.list_value_length(lists).to_numpy())
            order.append(rows)
    rows = np.flatnonzero(unusual)
    if len(rows):
        cut = [pieces(texts[i]) for i in rows.tolist()]
        flat.append(pa.array([p for c in cut for p in c], pa.large_string()))
        counts.append(np.array([len(c) for c in cut], np.int64))
        order.append(rows)
    return pa.chunked_array(flat).combine_chunks(), np.concatenate(order), np.concatenate(counts)


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, given a function that does so for a list of pieces."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self._encode, self._known, self._most = encode, {}, remembered

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """The ids of different pieces; those that are short are remembered."""
        if len(self._known) > self._most:
            self._known.clear()
        new = [p for p in distinct if p not in self._known]
        self._known.update(zip(new, self._encode(new)))
        out = list(map(self._known.__getitem__, distinct))
        for p in new:
            if len(p) > LONGEST:
                del self._known[p]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > TEXT_BLOCK:
                out += self._small(held)
                held, size = [], 0
                out.append(b"".join(self._small(list(blocks(text)))))
                continue
            held.append(text)
            size += len(text)
            if size > TEXT_BLOCK:
                out += self._small(held)
                held, size = [], 0
        return out + self._small(held)

    def _small(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        flat, order, counts = cut_all(texts)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        data = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        known, begins = np.frombuffer(b"".join(data), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = known[np.repeat(begins[codes] - (ends - each), each) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        out = [b""] * len(texts)
        for k, i, j in zip(order.tolist(), cuts[:-1], cuts[1:]):
            out[k] = ids[i:j].tobytes()
        return out
