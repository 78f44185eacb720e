"""Vectorised words and hashes over Arrow batches of texts.

All of it works on the UTF-8 bytes of a batch at once; a worker holds a few dozen bytes per byte of the
slice it works on, and slices hold about SLICE_BYTES of text (or one document, if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
WHITE = bytes([0x20, *range(0x09, 0x0E)])
LONG_WORD = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of several texts in one byte buffer; text ``i`` owns words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The public-domain splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, byte bounds of each row) for runs of rows of about SLICE_BYTES; a null is empty."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, "right")) - 1)
        high = min(high, len(texts))
        yield batch.slice(low, high - low), every[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def give_back() -> None:
    """Returns freed memory to the system, as Python workers stay when a stage has ended, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function on this system
        return


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def separators(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(WHITE + extra)] = True
    return table


def word_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its lanes of eight bytes are mixed into a state one after the other.

    The state goes through a non-linear permutation after every lane, so words of up to eight bytes never collide, and no pair of
    longer ones does by construction, as pairs do under a sum of powers. Words of over LONG_WORD bytes are hashed one by one.
    """
    padded = np.concatenate([letters, np.zeros(8, np.uint8)])
    length = ends - starts
    out = length.astype(np.uint64) * _ODD
    live = np.flatnonzero(length <= LONG_WORD)
    spread = np.arange(8)
    for lane in range(0, LONG_WORD, 8):
        live = live[length[live] > lane]
        for low in range(0, len(live), 1 << 16):
            some = live[low : low + (1 << 16)]
            at = starts[some] + lane
            bytes_ = padded[at[:, None] + spread]
            bytes_[spread >= (length[some] - lane)[:, None]] = 0
            out[some] = mix(out[some] ^ bytes_.view(np.uint64)[:, 0]) * _ODD
        if not len(live):
            break
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(letters[starts[k] : ends[k]].tobytes())
    return mix(out)


class WordHasher:
    """Splits texts into words and hashes each to 64 bits."""

    def __init__(self, lower: bool, extra_separators: bytes = b"") -> None:
        self.lower = lower_ascii() if lower else None
        self.separator = separators(extra_separators)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> Words:
        inside = ~self.separator[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edge = bounds[:-1][np.diff(bounds) > 0]
        begins[edge] = inside[edge]
        edge = bounds[1:][np.diff(bounds) > 0] - 1
        stops[edge] = inside[edge]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes = word_hashes(data if self.lower is None else self.lower[data], starts, ends)
        return Words(data, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))


def multipliers(n: int) -> np.ndarray:
    """Odd numbers without a pattern, one a place in a run."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive words (runs may cross texts; callers cut by text)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    odd = multipliers(size)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out += hashes[i : i + len(out)] * odd[i]
    return mix(out)


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from ``start`` to ``end`` of each span; spans are short."""
    out, length = (end - start).astype(np.uint64), end - start
    for i, odd in enumerate(multipliers(int(length.max(initial=0)))):
        live = np.flatnonzero(length > i)
        out[live] += hashes[start[live] + i] * odd
    return mix(out)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Of each text, its sorted distinct run hashes; the whole sequence as one if it is shorter; empty without words."""
    whole = runs(words.hashes, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield runs(words.hashes[a:b], b - a) + np.uint64(b - a)
        else:
            yield whole[:0]
