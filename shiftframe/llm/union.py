"""Union of array positions inside one task, as a vector of labels."""

from __future__ import annotations

import numpy as np


def settle(labels: np.ndarray) -> np.ndarray:
    """Follow labels until every position has the label of its root."""
    while True:
        further = labels[labels]
        if np.array_equal(further, labels):
            return labels
        labels = further


def unite(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining ``left[i]`` with ``right[i]``; the smallest position of a group is its label."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        labels = settle(labels)
