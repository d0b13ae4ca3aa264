"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def stretches(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches whose sizes sum to at most `limit`, or of one row; without rows one empty stretch."""
    ends, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(sizes) or a == 0:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, min(b, len(sizes))
        a = b
