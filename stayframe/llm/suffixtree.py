"""Suffix trees of symbol sequences, and constant-time longest common extensions on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Minima of up to ``2 ** LEVELS`` neighbours are kept for every place of the tour, longer ones per block.
LEVELS = 5


class RangeMinimum:
    """Minimum of any range of an array in constant time.

    Two overlapping windows of a power of two cover a range. Windows of up to a block's size start anywhere; longer ones
    start and end with blocks, so memory stays a small multiple of the array.
    """

    def __init__(self, values: np.ndarray):
        self.near = [values]
        for level in range(LEVELS):
            self.near.append(self._doubled(self.near[-1], 1 << level))
        block = 1 << LEVELS
        padded = np.concatenate([values, np.full(-len(values) % block, np.iinfo(values.dtype).max, dtype=values.dtype)])
        self.far = [padded.reshape(-1, block).min(axis=1)]
        while 2 << (len(self.far) - 1) <= len(self.far[0]):
            self.far.append(self._doubled(self.far[-1], 1 << (len(self.far) - 1)))

    @staticmethod
    def _doubled(minima: np.ndarray, reach: int) -> np.ndarray:
        out = minima.copy()
        out[:-reach] = np.minimum(minima[:-reach], minima[reach:]) if reach < len(minima) else out[:-reach]
        return out

    @staticmethod
    def _covered(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima from ``first`` to ``last``, both included, by two windows of the largest power of two that fits."""
        out = np.empty(len(first), dtype=levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        level = np.minimum(level, len(levels) - 1)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(levels[k][first[own]], levels[k][last[own] + 1 - (1 << k)])
        return out

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of ``values[first[i]:last[i] + 1]`` for every i; no range is empty."""
        out = np.empty(len(first), dtype=self.near[0].dtype)
        block = 1 << LEVELS
        short = last - first < 2 * block
        out[short] = self._covered(self.near, first[short], last[short])
        long = np.flatnonzero(~short)
        left, right = first[long], last[long]
        edges = np.minimum(self.near[LEVELS][left], self.near[LEVELS][right + 1 - block])
        inner = self._covered(self.far, -(-left // block), (right + 1) // block - 1)
        out[long] = np.minimum(edges, inner)
        return out


@dataclass(frozen=True)
class _Nodes:
    """Node 0 is the root. The edge into a node is labelled ``symbols[start:stop]``; ``child`` maps node * width + symbol."""

    start: list[int]
    stop: list[int]
    child: dict[int, int]


def ukkonen(symbols: list[int], width: int) -> _Nodes:
    """The suffix tree of ``symbols`` (each below ``width``), whose last symbol stands nowhere else. On-line, in linear time.

    Leaves come into being in the order of their suffixes.
    """
    n = len(symbols)
    start, stop, link, child = [0], [0], [0], {}
    # The active point: ``length`` symbols down the edge of ``node`` that begins with ``symbols[edge]``.
    node = edge = length = waiting = 0
    for at, symbol in enumerate(symbols):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = at
            key = node * width + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(at)
                stop.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                begin = start[below]
                span = stop[below] - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if symbols[begin + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                fork = len(start)
                child[key] = fork
                child[fork * width + symbol] = fork + 1
                child[fork * width + symbols[begin + length]] = below
                start += (begin, at)
                stop += (begin + length, n)
                link += (0, 0)
                start[below] = begin + length
                if unlinked:
                    link[unlinked] = fork
                unlinked = fork
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = at - waiting + 1
    return _Nodes(start, stop, child)


class Extensions:
    """Longest common extensions of the suffixes of a sequence, from its suffix tree.

    The tree is walked once. The tour notes the string depth of every node it enters or comes back to; two suffixes share
    as many symbols as the least depth between their leaves says, which is that of their lowest common ancestor.
    """

    def __init__(self, symbols: list[int], width: int):
        nodes = ukkonen(symbols, width)
        n, count = len(symbols), len(nodes.start)
        keys = np.fromiter(nodes.child.keys(), dtype=np.int64, count=count - 1)
        below = np.fromiter(nodes.child.values(), dtype=np.int64, count=count - 1)
        order = np.argsort(keys)
        parents = keys[order] // width
        # Children of every node one after the other, the largest symbol first: the last one pushed is walked first.
        children = below[order][::-1].tolist()
        bounds = (count - 1 - np.searchsorted(parents, np.arange(count + 1))).tolist()
        start, stop = nodes.start, nodes.stop
        leaf = np.bincount(parents, minlength=count) == 0
        del nodes, keys, below, parents, order
        depth = [0] * count
        parent_depth = [0] * count
        walk = []
        stack = [0]
        while stack:
            node = stack.pop()
            walk.append(node)
            first, last = bounds[node + 1], bounds[node]
            if first < last:
                own = depth[node]
                for below_node in children[first:last]:
                    parent_depth[below_node] = own
                    depth[below_node] = own + stop[below_node] - start[below_node]
                    stack.append(below_node)
        walked = np.asarray(walk)
        tour = np.empty(2 * count, dtype=np.int32)
        tour[0::2] = np.asarray(parent_depth)[walked]
        tour[1::2] = np.asarray(depth)[walked]
        leaves = np.flatnonzero(leaf[walked])
        suffix = n - np.asarray(depth)[walked[leaves]]
        #: Where every suffix's leaf stands in the tour; it rises with the order of suffixes.
        self.place = np.empty(n, dtype=np.int64)
        self.place[suffix] = 2 * leaves + 1
        self.minimum = RangeMinimum(tour)

    def ranks(self) -> np.ndarray:
        """The place of every suffix in the sorted order of all."""
        out = np.empty(len(self.place), dtype=np.int64)
        out[np.argsort(self.place)] = np.arange(len(self.place))
        return out

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``left[i]`` and ``right[i]``, which differ, share from their start."""
        one, other = self.place[left], self.place[right]
        return self.minimum.of(np.minimum(one, other), np.maximum(one, other)).astype(np.int64)
