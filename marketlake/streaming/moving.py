"""Moving means of rows that come one after another."""

from __future__ import annotations

import numpy as np

BLOCK = 16


def window_sum(values: list[float], first: int) -> float:
    """The sum of a window's values, from the left; a whole block of 16 rows, counted from a symbol's first one, is added as one sum. ``first``
    is the number of the window's first row. DuckDB's windows of fewer than 272 rows add up so, and means that are equal but for rounding
    compare as in the SQL only if they are added up alike; ``sum`` corrects its rounding and so differs from both."""
    total, i = 0.0, 0
    while i < len(values):
        if (first + i) % BLOCK == 0 and i + BLOCK <= len(values):
            block = 0.0
            for x in values[i : i + BLOCK]:
                block += x
            total, i = total + block, i + BLOCK
        else:
            total, i = total + values[i], i + 1
    return total


def window_means(values: np.ndarray, n: int, first: int) -> np.ndarray:
    """Of each value the mean of the n values up to it, NaN before the n-th, added up as ``window_sum`` does; ``first`` is the number of the first row."""
    means = np.full(len(values), np.nan)
    if len(values) < n:
        return means
    windows = np.lib.stride_tricks.sliding_window_view(values, n)
    for r in range(BLOCK):  # windows that begin at one place of their block
        own = windows[(r - first) % BLOCK :: BLOCK]
        total, i = np.zeros(len(own)), 0
        while i < n:
            whole = (r + i) % BLOCK == 0 and i + BLOCK <= n
            part = np.zeros(len(own))
            for k in range(i, i + (BLOCK if whole else 1)):
                part = part + own[:, k]
            total, i = total + part, i + (BLOCK if whole else 1)
        means[n - 1 + (r - first) % BLOCK :: BLOCK] = total / n
    return means
