"""Hashed character n-grams of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FACTOR, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts, each between two blanks, and where each begins (with the end)."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.r_[0, np.cumsum(sizes)]


def hashed(points: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: a bucket per position, and the first and past-the-last position of each text."""
    value = points.astype(np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            value = value[:-1] * FACTOR + points[n - 1 :]
        if n in sizes:
            mixed = (value ^ (value >> np.uint32(15)) ^ np.uint32(n * 0x51ED27)) * SPREAD
            yield (mixed >> np.uint32(32 - bits)).astype(np.int32), at[:-1], np.maximum(at[:-1], at[1:] - n + 1)


def buckets(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """All buckets of one text, repeats included."""
    points, at = points_of([text])
    return np.concatenate([h[: int(end[0])] for h, _, end in hashed(points, at, sizes, bits)])


def sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of values[first:last] for each text."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[last] - total[first]
