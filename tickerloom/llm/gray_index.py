"""A hierarchical index over fingerprints in Gray order, and the search for close ones in it.

Fingerprints of a group are sorted by their Gray rank, so that neighbours differ in few bits. Runs of neighbours get
a node that holds the bits all of them share, as a mask and a value; runs of nodes get a node of their own, up to
one root. A node keeps only the bits that no node above it holds. A search goes down from the root and adds up the
differences at the masked bits; a node whose sum is beyond the limit is left out with everything below it. At a
leaf the sum is the whole distance. Many groups are built and searched at once, level by level.
"""

from __future__ import annotations

import numpy as np

#: Children of a node.
FANOUT = 8
#: Most (query, leaf) pairs that one step of the search may come to; it bounds a worker's memory.
STEP_PAIRS = 2_000_000

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the Gray sequence: every bit is the parity of the bits from the top down to it."""
    r = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(shift))
    return r


class GrayForest:
    """One tree for each group; ``group`` must be non-negative integers."""

    def __init__(self, group: np.ndarray, value: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(value), group))
        self.order = order
        self.value = [value[order].astype(np.uint64)]
        self.mask = [np.full(len(order), _ALL)]
        self.group = [group[order]]
        self.start: list[np.ndarray] = []  # of the children, per level from 1 up
        self.stop: list[np.ndarray] = []
        while len(self.group[-1]) and (np.diff(self.group[-1]) == 0).any():
            own = self.group[-1]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            head = np.flatnonzero(place % fanout == 0)
            size = np.diff(np.r_[head, len(own)])
            value_of, mask_of = self.value[-1][head], self.mask[-1]
            unlike = (self.value[-1] ^ np.repeat(value_of, size)) | ~mask_of
            shared = ~np.bitwise_or.reduceat(unlike, head)
            self.value.append(value_of & shared)
            self.mask.append(shared)
            self.group.append(own[head])
            self.start.append(head)
            self.stop.append(np.r_[head[1:], len(own)])
        # What a node adds: its own bits without those of the node above.
        self.own = [m.copy() for m in self.mask]
        for level in range(len(self.mask) - 1):
            above = np.repeat(self.mask[level + 1], self.stop[level] - self.start[level])
            self.own[level] &= ~above

    def close_pairs(self, limit: int):
        """Blocks of pairs (i, j), i < j in sorted order, of one group and at most ``limit`` bits apart."""
        n = len(self.order)
        if not n:
            return
        own = self.group[0]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, n])
        reach = np.cumsum(np.repeat(size, size))
        root = np.repeat(np.arange(len(first)), size)
        at = 0
        while at < n:
            base = reach[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(reach, base + STEP_PAIRS, "right")))
            query = np.arange(at, end)
            yield self._search(query, root[at:end], limit)
            at = end

    def _search(self, query: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        code = self.value[0]
        top = len(self.value) - 1
        sums = np.bitwise_count((code[query] ^ self.value[top][node]) & self.own[top][node]).astype(np.int64)
        for level in range(top - 1, -1, -1):
            start, stop = self.start[level][node], self.stop[level][node]
            size = stop - start
            query, sums = np.repeat(query, size), np.repeat(sums, size)
            before = np.cumsum(size) - size
            node = np.arange(len(query)) - np.repeat(before - start, size)
            sums = sums + np.bitwise_count((code[query] ^ self.value[level][node]) & self.own[level][node])
            keep = sums <= limit
            query, node, sums = query[keep], node[keep], sums[keep]
        keep = (query < node) & (sums <= limit)
        return query[keep], node[keep]

    def roots(self, limit: int) -> np.ndarray:
        """For each input row, the row that stands for all that close pairs connect it with."""
        label = np.arange(len(self.order))
        for a, b in self.close_pairs(limit):
            label = connect(label, a, b)
        back = np.empty_like(label)
        back[self.order] = self.order[label]
        return back


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs (a, b) are connected; a label is the smallest place it is connected with."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (nearer := label[label]).tobytes() != label.tobytes():
            label = nearer
    return label
