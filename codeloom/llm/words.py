"""Words of whole texts as arrays: where they stand, whose they are, and a 64-bit key of each.

Texts are read as UTF-8 bytes in an Arrow buffer, not one by one. A word's key is a
polynomial of its bytes modulo 2**64, mixed; two different words share a key with a
chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Bytes of text that are expanded at a time (about 20 times as much memory).
PIECE_BYTES = 4_000_000
RADIX = 0x9E3779B97F4A7C15 | 1
#: Lower case of A-Z alone.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: What stands between words: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
MARK = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
SYMBOLS = common.mix64(np.arange(1, 257, dtype=np.uint64))


@dataclass
class Piece:
    """Words of some rows. Of a text that is longer than a piece, each piece but the first repeats the words before it."""

    data: np.ndarray  # bytes
    start: np.ndarray  # of each word, in data
    stop: np.ndarray
    row: np.ndarray  # of each word
    repeated: np.ndarray  # number of leading words that the piece before had too
    closed: np.ndarray  # rows whose text ends here

    def keys(self) -> np.ndarray:
        """A key for each word."""
        n = len(self.data) + 1
        up = powers(RADIX, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(SYMBOLS[self.data] * up[:-1], out=sums[1:])
        down = powers(pow(RADIX, -1, 1 << 64), n)
        return common.mix64((sums[self.stop] - sums[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.stop[k]].tobytes()


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, min(1 << n.bit_length(), PIECE_BYTES + 1)), base, np.uint64)  # as many as pieces ask for, not all that they may
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= PIECE_BYTES + 1:
            _POWERS[base] = known
    return known[:n]


def key_of(word: bytes) -> int:
    """The key of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(Piece(data, np.array([0]), np.array([len(data)]), np.array([0]), np.array(0), np.array([0])).keys()[0])


def split(data: np.ndarray, edges: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in data; a word does not cross an edge."""
    inside = ~between[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = edges[(edges > 0) & (edges < len(data))]
    begins[at] = inside[at]
    ends[at - 1] = inside[at - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def pieces(batch: pa.RecordBatch, between: np.ndarray, lower: bool = True, repeat: int = 0, limit: int = PIECE_BYTES, column: str = "text") -> Iterator[Piece]:
    """The words of a batch, of about `limit` bytes at a time. Null texts are empty.

    common.slices cuts batches by the same measure, so that only a single long text has
    several pieces. It is cut between words; a word is never cut.
    """
    array = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    every = np.arange(len(array))
    if len(array) > 1 or len(whole) <= limit:
        data = LOWER[whole] if lower else whole
        start, stop = split(data, offsets, between)
        yield Piece(data, start, stop, np.searchsorted(offsets, start, "right") - 1, np.array(0), every)
        return
    at, begin, kept = 0, 0, 0  # the piece reads from begin, its own words start at `at`
    while at < len(whole):
        end = min(at + limit, len(whole))
        while end < len(whole):  # on to a blank
            ahead = np.flatnonzero(between[LOWER[whole[end : end + limit]] if lower else whole[end : end + limit]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + limit, len(whole))
        data = LOWER[whole[begin:end]] if lower else whole[begin:end]
        start, stop = split(data, np.zeros(0, np.int64), between)
        yield Piece(data, start, stop, np.zeros(len(start), np.int64), np.array(kept), every if end == len(whole) else every[:0])
        kept = min(repeat, len(start))
        begin = begin + int(start[-kept]) if kept else end
        at = end
