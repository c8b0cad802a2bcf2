"""Vectors as whole numbers: what clustering and the mining of negatives share.

A component x becomes floor(scale * x), x as double. A vector takes no part if it is null, if a component is null or not
finite, or if a component's number is so large that a sum of squared differences of two such vectors could leave a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers in one run of vectors, so that arrays stay small.
RUN = 1 << 20


def most_of(size: int) -> int:
    """The largest magnitude of a component with which (2 * magnitude)^2 * size fits a long; 2^30 at most."""
    return min(1 << 30, math.isqrt((2**63 - 1) // max(size, 1)) // 2)


def whole(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in a column of lists of doubles: the rows that hold such a vector and take part, and their numbers, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    lengths = np.maximum(sizes, 0)
    first = np.cumsum(lengths) - lengths
    values = column.flatten().to_numpy(zero_copy_only=False)  # a null component is a NaN
    for size in np.unique(sizes[sizes >= 0]):
        rows, most = np.flatnonzero(sizes == size), most_of(int(size))
        for at in range(0, len(rows), step := max(1, RUN // max(int(size), 1))):
            own = rows[at : at + step]
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(values[first[own][:, None] + np.arange(size)] * scale) if size else np.zeros((len(own), 0))
                fits = (np.abs(x) <= most).all(axis=1)  # false for NaN and infinity
            yield own[fits], x[fits].astype(np.int64)


def packed(numbers: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    return pa.array([x.tobytes() for x in np.ascontiguousarray(numbers)], pa.binary())
