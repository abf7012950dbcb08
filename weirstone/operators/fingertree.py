"""A finger B-tree of partial aggregates keyed by event time.

Leaves hold one partial (n, sum, min, max) per key, inner nodes the partial of their whole subtree. Inserting starts
at the right finger and climbs only as far as the key is out of order, then folds the new partial into the ancestors.
`evict_below` cuts whole subtrees off the left in one walk down the spine. No rebalancing is needed after it: depth
only shrinks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

WIDTH = 16


class _Node:
    __slots__ = ("agg", "items", "keys", "leaf", "parent")

    def __init__(self, leaf: bool, keys: list, items: list, parent: _Node | None = None) -> None:
        self.leaf, self.keys, self.items, self.parent = leaf, keys, items, parent  # inner: keys[i] is at most the least key under items[i]
        self.agg: list | None = None
        if not leaf:
            for kid in items:
                kid.parent = self
        self.refold()

    def refold(self) -> None:
        agg = None
        for x in self.items:
            agg = fold(agg, x if self.leaf else x.agg)
        self.agg = agg


def fold(into: list | None, part: list | None) -> list | None:
    """Folds part into the first partial, in place."""
    if part is None:
        return into
    if into is None:
        return list(part)
    into[0] += part[0]
    into[1] += part[1]
    if part[2] < into[2]:
        into[2] = part[2]
    if part[3] > into[3]:
        into[3] = part[3]
    return into


class FingerTree:
    def __init__(self) -> None:
        self.root = self.finger = _Node(True, [], [])

    def total(self) -> list | None:
        return self.root.agg

    def least(self):
        node = self.root
        while not node.leaf:
            node = node.items[0]
        return node.keys[0] if node.keys else None

    def add(self, key, part: list) -> None:
        node = self.finger
        while node.parent is not None and (not node.keys or key < node.keys[0]):
            node = node.parent
        while not node.leaf:
            node = node.items[max(0, bisect_right(node.keys, key) - 1)]
        i = bisect_left(node.keys, key)
        if i < len(node.keys) and node.keys[i] == key:
            fold(node.items[i], part)
        else:
            node.keys.insert(i, key)
            node.items.insert(i, list(part))
        leaf, up = node, node
        while up is not None:
            up.agg = fold(up.agg, part)
            if up.parent is not None and up.keys and key < up.parent.keys[0]:
                up.parent.keys[0] = key
            up = up.parent
        if len(leaf.keys) > WIDTH:
            self._split(leaf)

    def _split(self, node: _Node) -> None:
        while node is not None and len(node.keys) > WIDTH:
            half = len(node.keys) // 2
            right = _Node(node.leaf, node.keys[half:], node.items[half:])
            del node.keys[half:], node.items[half:]
            node.refold()
            if node is self.finger:
                self.finger = right
            if node.parent is None:
                self.root = _Node(False, [node.keys[0], right.keys[0]], [node, right])
                return
            up = node.parent
            i = up.items.index(node)
            up.keys.insert(i + 1, right.keys[0])
            up.items.insert(i + 1, right)
            right.parent = up
            node = up

    def range(self, low, high) -> list | None:
        """The partial of all keys in [low, high)."""
        return self._range(self.root, low, high, None, None)

    def _range(self, node: _Node, low, high, least, most) -> list | None:
        if least is not None and low <= least and most is not None and most <= high:
            return None if node.agg is None else list(node.agg)
        out = None
        if node.leaf:
            for part in node.items[bisect_left(node.keys, low) : bisect_left(node.keys, high)]:
                out = fold(out, part)
            return out
        for i, kid in enumerate(node.items):
            lo, hi = node.keys[i], node.keys[i + 1] if i + 1 < len(node.keys) else most
            if (hi is None or hi > low) and lo < high:
                out = fold(out, self._range(kid, low, high, lo, hi))
        return out

    def items(self) -> Iterator[tuple]:
        yield from _walk(self.root)

    def evict_below(self, key) -> list[tuple]:
        """Takes all keys below `key` out, whole subtrees at once; gives them in order."""
        gone: list[tuple] = []
        path, node = [], self.root
        while True:
            path.append(node)
            if node.leaf:
                i = bisect_left(node.keys, key)
                gone.extend(zip(node.keys[:i], node.items[:i]))
                del node.keys[:i], node.items[:i]
                break
            i = max(0, bisect_right(node.keys, key) - 1)
            for kid in node.items[:i]:
                gone.extend(_walk(kid))
            del node.keys[:i], node.items[:i]
            node = node.items[0]
        for node in reversed(path):
            if not node.leaf and not node.items[0].keys:  # an emptied child goes; the last leaf stays as the finger
                if len(node.items) > 1:
                    del node.keys[0], node.items[0]
                else:
                    node.keys.clear()
            node.refold()
        while not self.root.leaf and len(self.root.items) == 1:
            self.root = self.root.items[0]
            self.root.parent = None
        while not self.root.leaf and not self.root.keys:
            self.root = self.root.items[0]
            self.root.parent = None
        return gone


def _walk(node: _Node) -> Iterator[tuple]:
    if node.leaf:
        yield from zip(node.keys, node.items)
    else:
        for kid in node.items:
            yield from _walk(kid)
