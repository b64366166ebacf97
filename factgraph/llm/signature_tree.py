"""Signature trees over sets: OR-combined token bitmaps with size ranges, joined by a dual traversal."""

from __future__ import annotations

import numpy as np

FANOUT = 8
PAIRS_AT_ONCE = 1 << 16


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union."""
    return 100 * common >= percent * (a + b - common)


class Tree:
    """Levels from single sets (0) to a root; a node knows the OR of its sets' bitmaps, their sizes' range and the fewest bits of one."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        size = np.array([len(s) for s in sets], np.int64)
        first = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((first, size))
        maps = np.zeros((len(sets), bits), bool)
        for row, i in enumerate(self.order):
            maps[row, (sets[i] % np.uint64(bits)).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1).view(np.uint64)
        self.size = size[self.order]
        self.levels = [(packed, self.size, self.size, np.bitwise_count(packed).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps_, low, high, fewest = self.levels[-1]
            at = np.arange(0, len(maps_), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps_, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(fewest, at)))

    def lift(self, height: int) -> None:
        """Repeat the root so that the tree has as many levels as another."""
        while len(self.levels) < height:
            self.levels.append(self.levels[-1])

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child) of all children."""
        below, here = len(self.levels[level - 1][0]), len(self.levels[level][0])
        if below == here:
            return np.arange(len(nodes)), nodes
        begin = nodes * FANOUT
        count = np.minimum(begin + FANOUT, below) - begin
        return np.repeat(np.arange(len(nodes)), count), np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def overlap_possible(one: Side, two: Side, percent: int) -> np.ndarray:
    """Whether sets below pairs of nodes (bitmaps, smallest and largest size, fewest bits) can have overlap enough."""
    (bits_a, low_a, high_a, few_a), (bits_b, low_b, high_b, few_b) = one, two
    shared = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64)
    most = np.minimum(high_a - np.maximum(0, few_a - shared), high_b - np.maximum(0, few_b - shared))
    return linked(most, low_a, low_b, percent) & (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)


def possible(one: Tree, two: Tree, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair of sets below the nodes can have overlap enough."""
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), PAIRS_AT_ONCE):
        p, q = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
        keep[i : i + PAIRS_AT_ONCE] = overlap_possible(tuple(x[p] for x in one.levels[level]), tuple(x[q] for x in two.levels[level]), percent)
    return keep


def join(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets (sorted distinct uint64 tokens) between two lists, or i < j within one; empty sets link with nothing."""
    none = np.zeros(0, np.int64)
    if not one or two is not None and not two:
        return none, none
    largest = max(len(s) for s in one + (two or []))
    bits = 64
    while bits < min(2 * largest, 1 << 14):
        bits *= 2
    left = Tree(one, bits)
    right = left if two is None else Tree(two, bits)
    height = max(len(left.levels), len(right.levels))
    left.lift(height)
    right.lift(height)
    a = b = np.zeros(1, np.int64)
    for level in range(height - 1, -1, -1):
        if level < height - 1:
            at, a = left.children(level + 1, a)
            b = b[at]
            at, b = right.children(level + 1, b)
            a = a[at]
            if two is None:
                a, b = a[a <= b], b[a <= b]
        keep = possible(left, right, level, a, b, percent)
        a, b = a[keep], b[keep]
    if two is None:
        a, b = a[a < b], b[a < b]
    return verified(left, right, one, one if two is None else two, a, b, percent)


def verified(left: Tree, right: Tree, one: list[np.ndarray], two: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tree places whose sets are linked, as indexes of the lists."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    need = np.unique(b)
    sets = [two[right.order[i]] for i in need]
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    out_a, out_b = [], []
    for x, at in zip(*np.unique(a, return_index=True), strict=True):
        own = one[left.order[x]]
        if not len(own):
            continue
        place = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        mark = np.zeros(len(vocabulary), bool)
        mark[place[vocabulary[place] == own]] = True
        until = np.searchsorted(a, x, "right")
        for i in range(at, until, 4096):
            other = b[i : min(until, i + 4096)]
            row = np.searchsorted(need, other)
            length = begin[row + 1] - begin[row]
            sums = np.concatenate(([0], np.cumsum(length)))
            hits = np.concatenate(([0], np.cumsum(mark[ids[np.repeat(begin[row] - sums[:-1], length) + np.arange(sums[-1])]])))
            good = linked(hits[sums[1:]] - hits[sums[:-1]], len(own), length, percent) & (length > 0)
            out_a.append(np.full(int(good.sum()), left.order[x]))
            out_b.append(right.order[other[good]])
    if not out_a:
        return a[:0], b[:0]
    return np.concatenate(out_a), np.concatenate(out_b)
