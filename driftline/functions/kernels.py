"""Sequential kernels over plain arrays, for grouped Arrow functions."""

from __future__ import annotations

import numpy as np


def douglas_peucker(lat: np.ndarray, lon: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with a stack of spans; distances in degrees."""
    keep = np.zeros(len(lat), bool)
    keep[[0, -1]] = True
    stack = [(0, len(lat) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dy, dx = lat[b] - lat[a], lon[b] - lon[a]
        length = np.hypot(dy, dx)
        inner = slice(a + 1, b)
        off = np.hypot(lat[inner] - lat[a], lon[inner] - lon[a]) if length == 0 else np.abs(dy * (lon[inner] - lon[a]) - dx * (lat[inner] - lat[a])) / length
        worst = int(off.argmax())
        if off[worst] > tolerance:
            mid = a + 1 + worst
            keep[mid] = True
            stack += [(a, mid), (mid, b)]
    return keep
