"""The local part of nearest neighbours: matrix products of blocks of vectors, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 512  # rows of a product that is held at once
HITS = 1_000_000
EXACT = 32_768  # pairs whose vectors are held at once


class _Best:
    """The k most similar of each row so far, ties to the smaller rank."""

    def __init__(self, rows: int, k: int, rank: np.ndarray) -> None:
        self.k, self.rank, self.least, self.waiting = k, rank, np.full(rows, -np.inf), 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, src: np.ndarray, dst: np.ndarray, similarity: np.ndarray) -> None:
        self.parts.append((src, dst, similarity))
        self.waiting += len(src)
        if self.waiting > HITS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        src, dst, similarity = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((self.rank[dst], -similarity, src))
        src, dst, similarity = src[order], dst[order], similarity[order]
        begins = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
        place = np.arange(len(src)) - np.repeat(begins, np.diff(np.r_[begins, len(src)]))
        last, kept = place == self.k - 1, place < self.k
        self.least[src[last]] = similarity[last]
        self.parts, self.waiting = [(src[kept], dst[kept], similarity[kept])], 0
        return self.parts[0]


def _targets(x: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """Which rows may be among the k nearest of another one: of equal vectors of a block the first k + 1."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel() if x.shape[1] else np.zeros(len(x), "V1")
    same = np.unique(keys, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((np.arange(len(x)), block, same))
    fresh = np.r_[True, (same[order][1:] != same[order][:-1]) | (block[order][1:] != block[order][:-1])] if len(x) else np.zeros(0, bool)
    begins = np.flatnonzero(fresh)
    out = np.zeros(len(x), bool)
    out[order] = np.arange(len(x)) - np.repeat(begins, np.diff(np.r_[begins, len(x)])) <= k
    return out


def _bar(m: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The k-th largest along an axis."""
    n = m.shape[axis]
    return np.full(m.shape[1 - axis], -np.inf) if n < k else np.partition(m, n - k, axis).take(n - k, axis)


def nearest(rows: pa.Table, pairs: Iterable[tuple[str, str]], k: int, threshold: float) -> pa.Table:
    """(src, dst, similarity) of the k nearest of each row (b, id, vector) among the blocks ``b`` that its own is paired with.

    ``pairs`` has each pair of blocks once. Products of single precision find what may reach the threshold and the k-th best, give or take their
    error; the similarity of these is computed pair by pair in double precision, by the same sums wherever a vector stands, so equal vectors tie.
    """
    rows = rows.sort_by([("b", "ascending"), ("id", "ascending")])
    ids, n = rows["id"].combine_chunks(), rows.num_rows
    rank = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
    x = np.asarray(rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    block = np.asarray(pc.rank(rows["b"].combine_chunks(), tiebreaker="dense")).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n else np.zeros(0, np.int64)
    span = dict(zip(rows["b"].take(pa.array(begins)).to_pylist(), zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True), strict=True))
    norm = np.maximum(np.sqrt((x * x).sum(1)), 1e-300)
    unit, slack = (x / norm[:, None]).astype(np.float32), (x.shape[1] + 8) * 1.2e-7
    wide = k + int(np.bincount(rank).max(initial=1)) - 1  # rows of the same id don't count
    target, best = _targets(x, block, wide), _Best(n, k, rank)
    for q, c in pairs:
        (low, high), (begin, end) = span[q], span[c]
        for at in range(low, high, SLAB):
            top = min(at + SLAB, high)
            left = at if q == c else begin
            m = unit[at:top] @ unit[left:end].T
            if q == c:
                m[:, : top - at][np.tri(top - at, dtype=bool)] = -2  # each pair once
            i, j = np.divmod(np.flatnonzero(m > threshold - slack), end - left)
            near = m[i, j]
            if len(i) > m.size // 16:
                keep = (near >= _bar(m, wide, 1)[i] - 2 * slack) | (near >= _bar(m, wide, 0)[j] - 2 * slack)
                i, j, near = i[keep], j[keep], near[keep]
            i, j = i + at, j + left
            keep = (target[i] | target[j]) & (near + slack >= np.minimum(best.least[i], best.least[j])) & (rank[i] != rank[j])
            i, j = i[keep], j[keep]
            for first in range(0, len(i), EXACT):
                a, b = i[first : first + EXACT], j[first : first + EXACT]
                similarity = (x[a] * x[b]).sum(1) / (norm[a] * norm[b])
                for src, dst in ((a, b), (b, a)):
                    some = (similarity > threshold) & target[dst] & (similarity >= best.least[src])
                    best.add(src[some], dst[some], similarity[some])
    src, dst, similarity = best.settle()
    return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst)), "similarity": similarity})
