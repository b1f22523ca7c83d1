"""Arrays of numbers in Arrow columns as rows of a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_length(column: pa.Array):
    """For each length: (rows, matrix of doubles) of the lists without null, missing or infinite parts."""
    lists = column.cast(pa.list_(pa.float64()))
    there = np.asarray(lists.is_valid())
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    size = np.diff(offsets)
    for n in np.unique(size[there]):
        rows = np.flatnonzero(there & (size == n))
        matrix = values[offsets[:-1][rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        fine = np.isfinite(matrix).all(axis=1)
        yield rows[fine], matrix[fine]


def fitted(matrix: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` components; zeros where there are fewer."""
    out = np.zeros((len(matrix), width))
    out[:, : min(width, matrix.shape[1])] = matrix[:, :width]
    return out


def k_means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most k centres of a bounded sample, the same on every run."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centers = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centers)[0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, squared distance to it)."""
    place, least = np.zeros(len(points), np.int64), np.zeros(len(points))
    for i in range(0, len(points), 4096):
        d = squared(points[i : i + 4096], centers)
        place[i : i + 4096] = d.argmin(axis=1)
        least[i : i + 4096] = d.min(axis=1)
    return place, least
