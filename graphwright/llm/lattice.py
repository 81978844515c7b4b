"""The E8 lattice: nearest points and neighbouring cells, vectorised."""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points whose coordinates are integers of even sum."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x``: the closer one of D8 and D8 + 1/2."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@cache
def shortest_vectors() -> np.ndarray:
    """The 240 differences between an E8 point and its nearest neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for signs in product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


def near_points(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The home point of every row and its ``count - 1`` neighbouring points closest to the row.

    Returns (rows, count, 8) points, home first, and (rows, count) squared distances beyond the home's.
    """
    home = nearest_e8(x)
    vectors = shortest_vectors()
    beyond = 2 - 2 * ((x - home) @ vectors.T)
    best = np.argpartition(beyond, count - 2, axis=1)[:, : count - 1] if count > 1 else np.zeros((len(x), 0), np.int64)
    cost = np.take_along_axis(beyond, best, axis=1)
    points = np.concatenate([home[:, None], home[:, None] + vectors[best]], axis=1)
    return points, np.concatenate([np.zeros((len(x), 1)), cost], axis=1)
