"""Words of many texts at once, as Arrow and numpy arrays.

Words are stretches without the white space of the contracts (space, tab, line feed, vertical tab, form feed, carriage
return). They are split and numbered by Arrow, so that no Python code runs for a single word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time (a longer text is a part of its own).
PART_BYTES = 1 << 22


@dataclass(frozen=True)
class Words:
    """The words of a number of texts one after another: their numbers in ``distinct``, and where each text's begin and end."""

    flat: pa.Array
    codes: np.ndarray
    ends: np.ndarray
    distinct: pa.Array

    @property
    def owner(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def split(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()  # texts that begin or end with white space
    if empty >= 0:
        kept = codes != empty
        flat, codes, ends = flat.filter(pa.array(kept)), codes[kept], np.concatenate(([0], np.cumsum(kept)))[ends]
    return Words(flat, codes, ends, coded.dictionary)


def joined(words: Words, kept: np.ndarray | None = None) -> pa.Array:
    """Each text's words (those ``kept``), joined by one space."""
    flat, ends = words.flat, words.ends
    if kept is not None:
        flat, ends = flat.filter(pa.array(kept)), np.concatenate(([0], np.cumsum(kept)))[ends]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), " ")


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring texts that have about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield first, i - first
            first, held = i, 0
        held += n + 1
    if first < len(sizes):
        yield first, len(sizes) - first
