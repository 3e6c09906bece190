"""A treap: a balanced search tree of distinct sortable keys with successor search."""

from __future__ import annotations

import random


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key, rank):
        self.key, self.rank, self.left, self.right = key, rank, None, None


def _split(node, key):
    """Trees of the keys below `key` and of those from it on."""
    if node is None:
        return None, None
    if node.key < key:
        node.right, rest = _split(node.right, key)
        return node, rest
    rest, node.left = _split(node.left, key)
    return rest, node


def _merge(low, high):
    if low is None or high is None:
        return low or high
    if low.rank > high.rank:
        low.right = _merge(low.right, high)
        return low
    high.left = _merge(low, high.left)
    return high


class BalancedTree:
    """Insert, remove, smallest key from a bound on, largest key; each in expected logarithmic time."""

    def __init__(self, keys=()):
        self._root, self._random = None, random.Random(7)
        for key in keys:
            self.insert(key)

    def insert(self, key) -> None:
        low, high = _split(self._root, key)
        self._root = _merge(_merge(low, _Node(key, self._random.random())), high)

    def remove(self, key) -> None:
        """Take out a key that is in the tree."""
        parent, node = None, self._root
        while node.key != key:
            parent, node = node, (node.left if key < node.key else node.right)
        joined = _merge(node.left, node.right)
        if parent is None:
            self._root = joined
        elif parent.left is node:
            parent.left = joined
        else:
            parent.right = joined

    def successor(self, key):
        """The smallest key that is not below `key`, or None."""
        found, node = None, self._root
        while node is not None:
            if node.key < key:
                node = node.right
            else:
                found, node = node.key, node.left
        return found

    def largest(self):
        node = self._root
        while node is not None and node.right is not None:
            node = node.right
        return node.key if node else None
