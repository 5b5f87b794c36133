"""Words of many texts at once, as arrays: used inside the tasks of the operators that count words or phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text that are cut into words at a time; a longer text is a slice of its own.
SLICE_BYTES = 3 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a slice in order: number of the distinct word, row of the text, piece of text (adjacent words of one
    piece have the same number), and the distinct words themselves."""

    code: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    distinct: pa.StringArray

    def hashes(self) -> np.ndarray:
        """64 bits per distinct word, the same in every process."""
        from pandas.util import hash_array

        return hash_array(self.distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def classes(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    """Per byte 0 for a word's, 1 for a separator, 2 for a separator that also ends a piece."""
    table = np.zeros(256, np.uint8)
    table[list(separators)] = 1
    table[list(breaks)] = 2
    return table


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield start, stop
        start = stop


def cut(texts: pa.Array, table: np.ndarray) -> Words:
    """Words of the texts with A-Z in lower case. Texts are not null; every byte above 127 belongs to a word unless the table says otherwise."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = table[raw]
    inside = kind == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    row = (np.searchsorted(ends, starts, side="right") - 1).astype(np.int32)
    piece = row + np.searchsorted(np.flatnonzero(kind == 2), starts).astype(np.int32)
    # the words one after the other, and where each begins
    begins = np.zeros(len(starts) + 1, np.int64)
    count = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    np.cumsum(count, out=begins[1:])
    joined = _LOWER[raw[inside]]
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(joined)).dictionary_encode()
    return Words(found.indices.to_numpy(zero_copy_only=False), row, piece, found.dictionary)
