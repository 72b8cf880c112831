"""A cover tree over norm-augmented vectors, searched for inner products within windows.

Each vector gets one more coordinate, so that all have the norm of the longest. The distance of a query, with a zero there,
then says its inner product exactly, and a ball of augmented vectors bounds the inner products of all vectors in it. The tree
is nested (a node's point is among its children's), covering (children lie within their parent's radius) and separated
(children of a node lie farther apart than their level's radius). The vectors of a subtree lie together in one array.
"""

from __future__ import annotations

import math

import numpy as np

#: Ratio of the radii of successive levels.
BASE = 1.3
#: Vectors up to which a node isn't split.
LEAF = 48
#: A node whose children would hold fewer vectors than this on average isn't split either, nothing would be left out by it.
LEAST = 4
#: Whole numbers up to here are exact in these types, and so are sums whose parts all are below.
EXACT = ((1 << 24, np.dtype("float32")), (1 << 53, np.dtype("float64")))


def products(rows: np.ndarray, start: np.ndarray, stop: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Products of one vector and the rows of the ranges, one range after the other."""
    if len(start) * 16 > (stop - start).sum():
        return rows[spans(start, stop)] @ one
    return np.concatenate([rows[a:b] @ one for a, b in zip(start.tolist(), stop.tolist(), strict=True)])


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = stop - start
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - first, size)


class CoverTree:
    """``points`` are whole numbers, a row each; ``ids`` decide between equal scores, ``labels`` are for the search."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        rough = points.astype(float)
        norms = (rough * rough).sum(axis=1)
        self.top = float(norms.max(initial=0.0))
        lifted = np.hstack([rough, np.sqrt(np.maximum(self.top - norms, 0.0))[:, None]])
        order = np.arange(len(points))
        #: What rounding may add to a distance.
        self.blur = 1e-6 * math.sqrt(self.top)
        centre, radius, start, stop, child, children = [0], [0.0], [0], [len(order)], [0], [0]
        widest, node = None, 0
        while node < len(start) and len(order):
            a, b = start[node], stop[node]
            own = order[a:b]
            away = self._distances(lifted[own], lifted[centre[node]])
            reach = float(away.max())
            radius[node] = reach + self.blur
            widest = reach if widest is None else widest
            if b - a > leaf and reach > self.blur:
                # The widest radius of the levels that parts this node.
                level = math.floor(math.log(widest / reach) / math.log(BASE)) + 1
                apart = widest * BASE**-level
                while apart >= reach:
                    apart /= BASE
                net, left = [centre[node]], own[away > apart]
                while len(left) and LEAST * len(net) <= len(own):
                    net.append(left[0])
                    left = left[1:][self._distances(lifted[left[1:]], lifted[left[0]]) > apart]
                if LEAST * len(net) > len(own):
                    node += 1
                    continue
                # Augmented vectors are of one length, so the nearest centre has the largest product.
                part = np.argmax(lifted[own] @ lifted[net].T, axis=1)
                place = {c: i for i, c in enumerate(net)}
                part = np.array([place.get(p, k) for p, k in zip(own.tolist(), part.tolist(), strict=True)])
                by = np.argsort(part, kind="stable")
                order[a:b] = own[by]
                cuts = a + np.searchsorted(part[by], np.arange(len(net) + 1))
                child[node], children[node] = len(start), len(net)
                for c, x, y in zip(net, cuts, cuts[1:], strict=False):
                    centre.append(int(c))
                    radius.append(0.0)
                    start.append(int(x))
                    stop.append(int(y))
                    child.append(0)
                    children.append(0)
            node += 1
        self.radius = np.array(radius)
        self.start, self.stop = np.array(start), np.array(stop)
        self.child, self.children = np.array(child), np.array(children)
        self.points, self.ids, self.labels = points[order], ids[order], labels[order]
        self.centres = points[np.array(centre)] if len(order) else points
        self.cast: dict[np.dtype, tuple[np.ndarray, np.ndarray]] = {}

    def state(self) -> dict:
        """Plain arrays and numbers, which ``of`` makes a tree again."""
        return dict(vars(self))

    @classmethod
    def of(cls, state: dict) -> CoverTree:
        tree = cls.__new__(cls)
        vars(tree).update(state)
        return tree

    def _distances(self, lifted: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (self.top - lifted @ one), 0.0))

    def _arrays(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points, centres and query in the smallest type in which their products are exact; integers of any size last."""
        rough = query.astype(float)
        # No sum of some products of components is larger than the product of the lengths.
        most = 1.001 * max(math.sqrt(self.top), 1) * max(math.sqrt(rough @ rough), 1)
        kind = next((k for limit, k in EXACT if most < limit), np.dtype(object))
        if kind not in self.cast:
            self.cast[kind] = self.points.astype(kind), self.centres.astype(kind)
        return *self.cast[kind], query.astype(kind)

    def search(
        self, query: np.ndarray, label: int, same: bool, low: list, high: list, k: int
    ) -> tuple[list[list[tuple[int, int]]], int]:
        """The first ``k`` (score, id) of each window of inner products, ends included, and how many products were formed.

        Only vectors of the label, or only ones of other labels, count. Nodes are taken best first, by the highest score that
        they may hold within a window, a few and then ever more at a time; those that lie outside of every window, or below what
        it has already, are left out with all that is below them. Scores of leaves are exact.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in low]
        if not len(self.points) or not low:
            return best, 0
        points, centres, q = self._arrays(query)
        rough = query.astype(float)
        whole = float(rough @ rough) + self.top
        slack = 1e-9 * whole + 1
        # Ends of windows may be beyond any double; the search is by bounds that are a little wider.
        least, most = np.array([float(x) for x in low]), np.array([float(x) for x in high])

        def bounds(score: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            away = np.sqrt(np.maximum(whole - 2 * score.astype(float), 0.0))
            near, far = np.maximum(away - r, 0.0), away + r
            return (whole - near * near) / 2 + slack, (whole - far * far) / 2 - slack

        nodes = np.array([0])
        upper, lower = bounds(centres[:1] @ q, self.radius[:1])
        compared, few = 0, 2
        while True:
            may = (upper[:, None] >= least) & (lower[:, None] <= most)
            live = may.any(axis=1)
            nodes, upper, lower, may = nodes[live], upper[live], lower[live], may[live]
            if not len(nodes):
                return best, compared
            if len(nodes) > few:
                promise = np.where(may, np.minimum(upper[:, None], most), -np.inf).max(axis=1)
                split = np.argpartition(-promise, few)
                now, later = split[:few], split[few:]
            else:
                now, later = np.arange(len(nodes)), np.arange(0)
            taken, nodes, upper, lower = nodes[now], nodes[later], upper[later], lower[later]
            few *= 2
            leaves, inner = taken[self.children[taken] == 0], taken[self.children[taken] > 0]
            if len(leaves):
                own, scores = spans(self.start[leaves], self.stop[leaves]), products(points, self.start[leaves], self.stop[leaves], q)
                compared += len(own)
                wanted = (self.labels[own] == label) == same
                own, scores = own[wanted], scores[wanted]
                for j, (a, b) in enumerate(zip(low, high, strict=True)):
                    a = max(a, best[j][-1][0]) if len(best[j]) == k else a
                    fits = np.flatnonzero((scores >= a) & (scores <= b))
                    if len(fits):
                        if len(fits) > 4 * k and scores.dtype != object:
                            # Only what reaches the k-th highest can be among the first, ties included.
                            fits = fits[scores[fits] >= np.partition(scores[fits], -k)[-k]]
                        found = [(int(s), int(i)) for s, i in zip(scores[fits], self.ids[own[fits]], strict=True)]
                        best[j] = sorted(best[j] + found, key=lambda x: (-x[0], x[1]))[:k]
                        if len(best[j]) == k:
                            least[j] = max(least[j], float(best[j][-1][0]))
            if len(inner):
                first, last = self.child[inner], self.child[inner] + self.children[inner]
                below = spans(first, last)
                compared += len(below)
                up, lo = bounds(products(centres, first, last, q), self.radius[below])
                nodes, upper, lower = np.concatenate([nodes, below]), np.concatenate([upper, up]), np.concatenate([lower, lo])
