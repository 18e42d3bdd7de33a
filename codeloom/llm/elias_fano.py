"""Elias-Fano sequences and n-gram tries over flat arrays, searched many queries at a time.

A sequence of n values that never fall is kept as its low bits, packed, and its high
bits in unary: for each high value a one for each of its elements, then a zero. The
k-th zero ends the elements of high value k. Sequences are bytes (`dump`), read in
place as NumPy views of the buffer that holds them (`open`), without unpacking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Where the k-th one of a byte is.
IN_BYTE = np.array([[([j for j in range(8) if b >> j & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.int64)
U = np.uint64
#: Most low bits: read by one unaligned load of 64 bits.
MOST_LOW = 48


class Unary:
    """Numbers of elements of successive groups, a one for each element and a zero behind each group."""

    def __init__(self, bits: np.ndarray) -> None:
        """bits: 64-bit words, padded with ones."""
        self.bits = bits
        zeros = 64 - np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(zeros) - zeros

    @staticmethod
    def bytes_of(groups: np.ndarray, n_groups: int) -> bytes:
        """groups: of each element, ascending."""
        size = len(groups) + n_groups
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[groups + np.arange(len(groups))] = True
        bits[size:] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def zero(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th zero stands."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, x, at = k - self.before[word], ~self.bits[word], word * 64
        for half in (32, 16, 8):
            low = x & U((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            above = left >= ones
            left = left - ones * above
            x = np.where(above, x >> U(half), low)
            at = at + half * above
        return at + IN_BYTE[(x & U(255)).astype(np.int64), left]

    def bounds(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First element of each group, and the first behind it."""
        if not len(group):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stop = self.zero(group) - group
        start = np.zeros(len(group), np.int64)
        some = group > 0
        start[some] = self.zero(group[some] - 1) - group[some] + 1
        return start, stop


class Sequence:
    """A sequence that never falls, of values below 2**64."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.low_bits, self.n_high, n_words = (int(x) for x in np.frombuffer(data, np.int64, 4))
        self.high = Unary(np.frombuffer(data, np.uint64, n_words, 32))
        at = 32 + 8 * n_words
        self.low = np.ndarray((max(len(data) - at - 7, 0),), "<u8", data, at, (1,))

    @staticmethod
    def dump(values: np.ndarray, bound: int) -> bytes:
        """The bytes of ascending values, all below bound."""
        n = len(values)
        low_bits = min(max((max(bound, 1) // max(n, 1)).bit_length() - 1, 0), MOST_LOW)
        n_high = (max(bound, 1) - 1 >> low_bits) + 1
        high = Unary.bytes_of((values >> U(low_bits)).astype(np.int64), n_high)
        packed = []
        for at in range(0, n if low_bits else 0, 1 << 16):  # a multiple of eight values, so that parts end with a byte
            some = values[at : at + (1 << 16)]
            packed.append(np.packbits((some[:, None] >> np.arange(low_bits, dtype=np.uint64) & U(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
        return np.array([n, low_bits, n_high, len(high) // 8], np.int64).tobytes() + high + b"".join(packed) + bytes(8)

    def lows(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), np.uint64)
        at = k * self.low_bits
        return self.low[at >> 3] >> (at & 7).astype(np.uint64) & U((1 << self.low_bits) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is not in the sequence: its successor is found among those of the same high bits."""
        out = np.full(len(values), -1, np.int64)
        high = values >> U(self.low_bits)
        left = np.flatnonzero(high < U(self.n_high)) if self.n else out[:0]
        start, stop = self.high.bounds(high[left].astype(np.int64))
        end, want = stop.copy(), values[left] & U((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(start < stop)
        while len(open_):  # halves the range of those not decided
            middle = start[open_] + stop[open_] >> 1
            less = self.lows(middle) < want[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            stop[open_] = np.where(less, stop[open_], middle)
            open_ = open_[start[open_] < stop[open_]]
        there = np.flatnonzero(start < end)
        there = there[self.lows(start[there]) == want[there]]
        out[left[there]] = start[there]
        return out

    def values(self) -> np.ndarray:
        """All values, for tests and to build on."""
        starts, stops = self.high.bounds(np.arange(self.n_high))
        return np.repeat(np.arange(self.n_high, dtype=np.uint64), stops - starts) << U(self.low_bits) | self.lows(np.arange(self.n))


#: Bits of a root context and of a successor below its context.
ROOT_BITS, CHILD_BITS = 40, 24
CHILD = U((1 << CHILD_BITS) - 1)


@dataclass
class Trie:
    """Contexts (a word), their successors (pairs) and the successors of pairs (triples).

    A successor is told from others of its context by CHILD_BITS of its key: its value in
    its level is relative to the context, whose number stands above these bits. Pointers
    are monotone and in unary: where the successors of each pair begin.
    """

    roots: Sequence
    pairs: Sequence
    pair_code: np.ndarray  # quantised probability of each pair
    pair_left: np.ndarray | None  # 65535 times what the triples of each pair leave to shorter contexts
    pointers: Unary | None
    triples: Sequence | None
    triple_code: np.ndarray | None

    @staticmethod
    def columns(pairs: np.ndarray, pair_code: np.ndarray, triples: np.ndarray | None = None, triple_code: np.ndarray | None = None, pair_left: np.ndarray | None = None) -> dict[str, bytes | None]:
        """The levels as bytes. pairs: ROOT_BITS of the context above CHILD_BITS, ascending; triples: the number of the pair above CHILD_BITS."""
        context = pairs >> U(CHILD_BITS)
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = context[1:] != context[:-1]
        number = np.cumsum(fresh).astype(np.uint64) - U(1)
        out = {
            "roots": Sequence.dump(context[fresh], 1 << ROOT_BITS),
            "pairs": Sequence.dump(number << U(CHILD_BITS) | pairs & CHILD, int(fresh.sum()) << CHILD_BITS),
            "pair_code": pair_code.astype(np.uint8).tobytes(),
            "pair_left": None,
            "pointers": None,
            "triples": None,
            "triple_code": None,
        }
        if triples is not None:
            out |= {
                "pair_left": pair_left.astype(np.uint16).tobytes(),
                "pointers": Unary.bytes_of((triples >> U(CHILD_BITS)).astype(np.int64), len(pairs)),
                "triples": Sequence.dump(triples, len(pairs) << CHILD_BITS),
                "triple_code": triple_code.astype(np.uint8).tobytes(),
            }
        return out

    @staticmethod
    def open(row: dict[str, bytes | None]) -> Trie:
        whole = row["triples"] is not None
        return Trie(
            Sequence(row["roots"]),
            Sequence(row["pairs"]),
            np.frombuffer(row["pair_code"], np.uint8),
            np.frombuffer(row["pair_left"], np.uint16) if whole else None,
            Unary(np.frombuffer(row["pointers"], np.uint64)) if whole else None,
            Sequence(row["triples"]) if whole else None,
            np.frombuffer(row["triple_code"], np.uint8) if whole else None,
        )

    def find_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 where it is not there. Ascending queries are fastest."""
        context = pairs >> U(CHILD_BITS)
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = context[1:] != context[:-1]
        root = self.roots.find(context[fresh])[np.cumsum(fresh) - 1]
        out = np.full(len(pairs), -1, np.int64)
        there = np.flatnonzero(root >= 0)
        out[there] = self.pairs.find(root[there].astype(np.uint64) << U(CHILD_BITS) | pairs[there] & CHILD)
        return out

    def has_triples(self, pair: np.ndarray) -> np.ndarray:
        start, stop = self.pointers.bounds(pair)
        return start < stop

    def find_triples(self, pair: np.ndarray, child: np.ndarray) -> np.ndarray:
        return self.triples.find(pair.astype(np.uint64) << U(CHILD_BITS) | child)
