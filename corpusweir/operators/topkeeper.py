"""Running top-k of many queries inside one task."""

from __future__ import annotations

import numpy as np


class TopKeeper:
    """Best ``k`` candidates of each of ``n`` queries: score descending, then id.

    Blocks of a dense score matrix come in; what stays is at most a few times
    ``n * k`` candidates, whatever the number of blocks.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """``scores[row, query]`` of the documents ``ids``; ``allowed`` masks pairs out."""
        keep = scores >= self.floor
        if allowed is not None:
            keep &= allowed
        # A block that has few candidates left is not searched for its own k best.
        if len(ids) > self.k and np.count_nonzero(keep) > self.n * self.k:
            masked = np.where(keep, scores, -np.inf)
            keep &= scores >= np.partition(masked, len(ids) - self.k, axis=0)[len(ids) - self.k]
        rows, queries = np.nonzero(keep)
        self.parts.append((queries, ids[rows], scores[rows, queries]))
        self.size += len(rows)
        if self.size > 4 * self.n * self.k + 100_000:
            self._compress()

    def _compress(self) -> None:
        queries, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, queries))
        queries, ids, scores = queries[order], ids[order], scores[order]
        starts = np.searchsorted(queries, np.arange(self.n))
        place = np.arange(len(queries)) - starts[queries]
        keep = place < self.k
        last = place == self.k - 1
        self.floor[queries[last]] = scores[last]
        self.parts = [(queries[keep], ids[keep], scores[keep])]
        self.size = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query positions, ids, scores)."""
        if not self.parts:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, np.empty(0)
        self._compress()
        return self.parts[0]
