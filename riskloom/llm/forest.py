"""Links found inside one task, reduced to a spanning forest before they leave it."""

from __future__ import annotations

import numpy as np


class Forest:
    """Nodes ``0..n-1``; each label is the smallest node of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join the trees of all pairs at once."""
        while True:
            a, b = self.label[left], self.label[right]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            if not apart.any():
                return
            np.minimum.at(self.label, high[apart], low[apart])
            while not np.array_equal(self.label, shorter := self.label[self.label]):
                self.label = shorter

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One edge per node that is not the root of its tree: the node and its root."""
        node = np.nonzero(self.label != np.arange(len(self.label)))[0]
        return node, self.label[node]
