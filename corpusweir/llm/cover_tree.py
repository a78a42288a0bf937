"""A cover tree over unit vectors and the dual traversal that finds all close pairs.

Nodes are balls around one of their own vectors.  A node of some radius is divided by a net
of half that radius: centres lie further apart than it, every vector within it of one, and
the node's own centre is the first of them.  Two nodes are left alone if their centres lie
further apart than both covering radii and the threshold together; if all their vectors must
be close, they are counted as a whole; otherwise the wider one is divided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Members up to which a node stays whole; smaller children of a node are pooled.
LEAF, POOLED = 64, 4
#: What distances from products of doubles may be wrong by, with much to spare.
SLACK = 1e-6
#: Cosines nearer to the threshold than this are computed again from the vectors themselves.
UNSURE = 1e-9
#: Products that are held at once.
CELLS = 1 << 22


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(x: np.ndarray, radius: float, most: int) -> np.ndarray | None:
    """Positions of centres further apart than ``radius`` that cover all rows; the first row is one.

    None if they would be more than ``most``.
    """
    centres, held, close = [], np.empty((most + 1, x.shape[1])), 1 - radius * radius / 2
    for start in range(0, len(x), 256):
        part = x[start : start + 256]
        open_ = np.flatnonzero((part @ held[: len(centres)].T).max(axis=1, initial=-2) < close)
        among = part[open_] @ part[open_].T >= close
        covered = np.zeros(len(open_), bool)
        for i in range(len(open_)):
            if not covered[i]:
                if len(centres) == most:
                    return None
                held[len(centres)] = part[open_[i]]
                centres.append(start + open_[i])
                covered |= among[i]
    return np.array(centres)


@dataclass
class Node:
    members: np.ndarray
    centre: int
    radius: float
    children: list[int]


class CoverTree:
    """Node 0 is the root; ``members`` are positions in the rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.nodes = x, []
        if len(x):
            self._add(np.arange(len(x)), 0)
        open_ = list(range(len(self.nodes)))
        while open_:
            made = self._divide(self.nodes[open_.pop()])
            open_ += made

    def _add(self, members: np.ndarray, centre: int) -> int:
        radius = float(apart(self.x[members], self.x[centre : centre + 1]).max())
        self.nodes.append(Node(members, centre, radius, []))
        return len(self.nodes) - 1

    def _divide(self, node: Node) -> list[int]:
        if len(node.members) <= LEAF or node.radius < SLACK:
            return []
        members = np.concatenate(([node.centre], node.members[node.members != node.centre]))
        # The level's radius is a power of two, so radii halve from level to level.
        radius = 2.0 ** np.ceil(np.log2(node.radius))
        centres = None
        while centres is None or len(centres) == 1:
            radius /= 2
            centres = net(self.x[members], radius, max(LEAF, len(members) // 2))
            if centres is None:
                return []
        nearest = np.empty(len(members), np.int64)
        step = max(1, CELLS // len(centres))
        for start in range(0, len(members), step):
            nearest[start : start + step] = (self.x[members[start : start + step]] @ self.x[members[centres]].T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        groups = np.split(members[order], np.cumsum(np.bincount(nearest, minlength=len(centres)))[:-1])
        made, pooled = [], []
        for centre, group in zip(members[centres], groups, strict=True):
            if len(group) > POOLED:
                made.append(self._add(group, int(centre)))
            else:
                pooled.append(group)
        if not made:
            return []
        whole = list(made)
        if pooled and len(rest := np.concatenate(pooled)):
            # Scattered vectors have no ball of their own worth a node.
            whole.append(self._add(rest, node.centre))
        node.children = whole
        return made


class CloseRows:
    """Weights of the close rows of every row, and which rows hang together.

    ``weight[i]`` is how often row ``i`` stands for a vector.  Rows of the second set come
    after those of the first; without a second set rows are compared among themselves,
    each with itself too.
    """

    def __init__(self, raw: np.ndarray, weight: np.ndarray, first: int, cosine: float):
        self.raw, self.weight, self.cosine, self.limit = raw, weight, cosine, float(np.sqrt(2 - 2 * cosine))
        self.x = unit_rows(raw)
        self.total = np.zeros(len(raw), np.int64)
        self.parent = np.arange(len(raw))
        self.compared = 0
        self._blocks: dict[int, list[np.ndarray]] = {}
        left = CoverTree(self.x[:first])
        if first == len(raw):
            self._within(left)
        elif first:
            self._between(left, CoverTree(self.x[first:]), first)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def _join(self, a: int, b: int) -> None:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)

    def _whole(self, a: np.ndarray, b: np.ndarray) -> None:
        self.total[a] += self.weight[b].sum()
        if a is not b:
            self.total[b] += self.weight[a].sum()
        for i in np.concatenate((a[1:], b)):
            self._join(a[0], i)

    def _within(self, tree: CoverTree) -> None:
        nodes, open_ = tree.nodes, [0] if tree.nodes else []
        pairs: list[tuple[int, int]] = []
        while open_:
            i = open_.pop()
            node = nodes[i]
            if 2 * node.radius < self.limit - SLACK:
                self._whole(node.members, node.members)
            elif not node.children:
                self._block(node.members, node.members)
            else:
                kids = np.array(node.children)
                open_ += node.children
                pairs += self._classed(tree, tree, kids, kids, 0, 0, upper=True)
        self._descend(tree, tree, pairs, 0)

    def _between(self, left: CoverTree, right: CoverTree, first: int) -> None:
        self._descend(left, right, self._classed(left, right, np.array([0]), np.array([0]), 0, first), first)

    def _classed(self, left: CoverTree, right: CoverTree, a: np.ndarray, b: np.ndarray, at: int, to: int, upper: bool = False) -> list:
        """Pairs of nodes that are neither too far apart nor close as a whole."""
        na, nb = [left.nodes[i] for i in a], [right.nodes[i] for i in b]
        gap = apart(left.x[[n.centre for n in na]], right.x[[n.centre for n in nb]])
        reach = np.array([n.radius for n in na])[:, None] + np.array([n.radius for n in nb])
        near = gap - reach <= self.limit + SLACK
        if upper:
            near &= np.arange(len(a))[:, None] < np.arange(len(b))
        whole = near & (gap + reach < self.limit - SLACK)
        for i, j in np.argwhere(whole):
            self._whole(na[i].members + at, nb[j].members + to)
        return [(int(a[i]), int(b[j])) for i, j in np.argwhere(near & ~whole)]

    def _descend(self, left: CoverTree, right: CoverTree, pairs: list, to: int) -> None:
        leaves: dict[int, list[int]] = {}
        while pairs:
            i, j = pairs.pop()
            a, b = left.nodes[i], right.nodes[j]
            if not a.children and not b.children:
                leaves.setdefault(i, []).append(j)
            elif a.children and (a.radius >= b.radius or not b.children):
                pairs += self._classed(left, right, np.array(a.children), np.array([j]), 0, to)
            else:
                pairs += self._classed(left, right, np.array([i]), np.array(b.children), 0, to)
        for i, others in leaves.items():
            self._block(left.nodes[i].members, np.concatenate([right.nodes[j].members for j in others]) + to)

    def _block(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares rows one by one; ``a`` with itself if both are the same array."""
        step = max(1, CELLS // len(b))
        for start in range(0, len(a), step):
            rows = a[start : start + step]
            cosine = self.x[rows] @ self.x[b].T
            close = cosine >= self.cosine
            for i, j in np.argwhere(np.abs(cosine - self.cosine) < UNSURE):
                u, v = (self.raw[k] / np.abs(self.raw[k]).max() for k in (rows[i], b[j]))
                close[i, j] = u @ v / np.sqrt((u @ u) * (v @ v)) >= self.cosine
            if a is b:
                close[np.arange(len(rows)), np.arange(start, start + len(rows))] = True
            self.compared += close.size
            self.total[rows] += close @ self.weight[b]
            if a is not b:
                self.total[b] += self.weight[rows] @ close
            self._hang(rows, b, close)

    def _hang(self, a: np.ndarray, b: np.ndarray, close: np.ndarray) -> None:
        rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        if np.count_nonzero(close) <= 4 * (len(rows) + len(columns)):
            for i, j in np.argwhere(close):
                self._join(a[i], b[j])
            return
        # Dense: the smallest row that each one hangs on, until nothing changes.
        close = close[np.ix_(rows, columns)]
        label, none = np.arange(len(rows)), len(rows)
        while True:
            below = np.where(close, label[:, None], none).min(axis=0)
            now = np.where(close, below, none).min(axis=1)
            if (now == label).all():
                break
            label = now
        for i, m in zip(rows, label, strict=True):
            self._join(a[i], a[rows[m]])
        for j, m in zip(columns, below, strict=True):
            self._join(b[j], a[rows[m]])
