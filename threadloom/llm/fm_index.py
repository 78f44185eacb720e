"""A compressed FM-index in numpy: Burrows-Wheeler transform in a wavelet matrix of packed bits, backward search, locating by steps."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.blocks), np.int32)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Index of a text of small integers in which 0 ends a phrase; ``owners`` says whose each phrase is.

    No suffix array is kept: where a match lies is found by stepping back to its phrase's begin, and only phrases' begins have
    their owner stored. Ends of phrases count as different symbols in order of place, so all suffixes differ.
    """

    def __init__(self, text: np.ndarray, owners: np.ndarray) -> None:
        n, sigma = len(text), int(text.max()) + 1
        ends = text == 0
        rank, length = text.astype(np.int64) + int(ends.sum()), 1
        rank[ends] = np.arange(int(ends.sum()))
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - length)] = rank[length:] + 1
            values, rank = np.unique(rank * (n + sigma + 2) + ahead, return_inverse=True)
            rank, length = rank.reshape(n), 2 * length
            if len(values) == n:
                break
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels: list[tuple[int, BitRank, int]] = []
        rest = text[suffixes - 1]
        phrase = np.cumsum(ends) - ends  # the phrase of each place
        self.owner_of_begin = owners[phrase[suffixes[rest == 0]]]
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (rest >> shift & 1).astype(np.uint8)
            zeros = n - int(bits.sum())
            self.levels.append((shift, BitRank(bits), zeros))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``at`` of the transformed text."""
        return self._descend(symbols, at) - self.begin[symbols]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after each pattern has got one more symbol in front."""
        both = self.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        first = self.first[symbols]
        return first + both[: len(symbols)], first + both[len(symbols) :]

    def _before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before the suffix in each row, and how often it stands in the rows above."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.ones(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol |= bit << shift
        return symbol, at - self.begin[symbol]

    def owners(self, rows: np.ndarray) -> np.ndarray:
        """Whose phrase the suffix of each row lies in."""
        out, left, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows
        while len(left):
            symbol, rank = self._before(at)
            there = symbol == 0
            out[left[there]] = self.owner_of_begin[rank[there]]
            left, at = left[~there], self.first[symbol[~there]] + rank[~there]
        return out
