"""Words of an Arrow text column as arrays, without a Python object per word.

A word is a run of bytes other than space and \\x09-\\x0D; text boundaries end words too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class TextBytes:
    """The bytes of a text column (no nulls), one text after the other."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0]:offsets[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets - offsets[0]

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that are marked in ``table`` (256 flags)."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(table[self.data], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary array of data[cuts[i]:cuts[i + 1]]."""
    kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=width)),
                                                       pa.py_buffer(np.ascontiguousarray(data))])


def word_array(text: TextBytes) -> tuple[pa.Array, np.ndarray]:
    """All words (binary, in order) and the number of the text that each stands in."""
    shown = ~BLANK[text.data]
    first = np.zeros(len(shown) + 1, dtype=bool)
    first[text.offsets] = True                       # a text starts here (the last one ends)
    start = np.flatnonzero(shown & (first[:-1] | ~np.r_[False, shown[:-1]]))
    end = np.flatnonzero(shown & (first[1:] | ~np.r_[shown[1:], False])) + 1
    row = np.searchsorted(text.offsets, start, side="right") - 1
    cuts = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=cuts[1:])
    return slices(text.data[shown], cuts), row.astype(np.int64)


#: Classes of bytes for ``plain_words``: 0 blank, 1 letter, 2 digit, 3 mark, 4 what needs a closer look.
CLASS = np.full(256, 4, dtype=np.uint8)
CLASS[0x21:0x7F] = 3
CLASS[BLANK] = 0
CLASS[ord("0"):ord("9") + 1] = 2
CLASS[ord("A"):ord("Z") + 1] = CLASS[ord("a"):ord("z") + 1] = 1
CLASS[ord("'")] = 4


def plain_words(text: TextBytes) -> tuple[pa.Array, np.ndarray]:
    """The runs of non-blank bytes, those of plain ASCII already cut into lower-case words: runs
    of letters, single digits, runs of marks.  A run with a byte of class 4 or a ``<|`` stays
    whole and as it is.  Also the number of each piece's text."""
    data, n = text.data, len(text.data)
    kind = CLASS[data]
    shown = kind != 0
    first = np.zeros(n + 1, dtype=bool)
    first[text.offsets] = True
    begins = shown & (first[:-1] | ~np.r_[False, shown[:-1]])
    odd = kind == 4
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    number = np.cumsum(begins, dtype=np.int32)               # run of each byte, from 1
    whole = np.zeros(int(number[-1]) + 1 if n else 1, dtype=bool)
    whole[number[odd]] = True
    simple = shown & ~whole[number]
    before = np.r_[np.uint8(0), kind[:-1]] if n else kind
    start = begins | (simple & ((kind != before) | (kind == 2)))
    at = np.flatnonzero(start)
    row = np.searchsorted(text.offsets, at, side="right") - 1
    cuts = np.r_[np.cumsum(shown)[at] - 1, np.count_nonzero(shown)] if n else np.zeros(1, np.int64)
    low = np.where(simple, LOWER[data], data)
    return slices(low[shown], cuts), row.astype(np.int64)


def spaced_words(text: TextBytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts cut into words with a blank before them as the common byte-level pattern does
    (contractions, or an optional space with letters, digits or marks, or white space): the
    pieces, the number of each one's text, and which of them need a closer look.

    First a cut stands before a run of blanks where the character before it is surely no white
    space of any kind (printable ASCII, or a two-byte character from U+00C0 up), so that runs of
    Unicode white space stay whole.  Such a part that is plain ASCII is then cut at every
    change of class; of several blanks the last stands apart, and goes with what follows if it
    is a space.  A part with a byte of class 4 stays whole (closer look)."""
    data, n = text.data, len(text.data)
    if not n:
        return slices(data, np.zeros(1, np.int64)), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = CLASS[data]
    blank = kind == 0
    first = np.zeros(n + 1, dtype=bool)
    first[text.offsets] = True
    before, lead = np.r_[np.uint8(0), data[:-1]], np.r_[np.zeros(2, np.uint8), data[:-2]][:n]
    solid = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))
    begins = first[:-1] | (blank & solid)
    number = np.cumsum(begins, dtype=np.int32) - 1
    whole = np.zeros(int(number[-1]) + 1, dtype=bool)
    whole[number[kind == 4]] = True
    shown_next = ~first[1:] & np.r_[~blank[1:], False]
    kind_before = np.r_[np.uint8(0), kind[:-1]]
    cut = np.where(blank, (kind_before != 0) | shown_next, (kind != kind_before) & (before != 0x20))
    start = begins | (cut & ~whole[number])
    at = np.flatnonzero(start)
    row = np.searchsorted(text.offsets, at, side="right") - 1
    return slices(data, np.r_[at, n]), row.astype(np.int64), whole[number[at]]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + length[i]] of all i, one after the other."""
    ends = np.cumsum(length)
    shift = np.repeat(start - (ends - length), length)
    shift += np.arange(len(shift))
    return flat[shift]


def byte_strings(values: pa.Array) -> list[bytes]:
    """A binary array's values (no nulls), as ``to_pylist`` gives them but faster."""
    values = values.cast(pa.large_binary())
    cuts = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    if not len(values) or cuts[-1] == cuts[0]:
        return [b""] * len(values)
    raw, cuts = values.buffers()[2].to_pybytes(), cuts.tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
