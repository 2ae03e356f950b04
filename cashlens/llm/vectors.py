"""Helpers of the vector operators: rows of Arrow lists as whole-number matrices, and the SQL shared by their queries."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG_MAX = 2**63 - 1


def magnitude(dims: int) -> int:
    """The largest whole number for which no squared distance of two vectors leaves 64 bits."""
    return isqrt(LONG_MAX // (4 * max(1, dims)))


def finite_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold exactly ``dims`` components, none null or non-finite, and those rows as doubles."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dims))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    ok = lengths == dims
    ok[ok] = bad[starts[ok] + dims] == bad[starts[ok]]
    rows = np.flatnonzero(ok)
    return rows, flat[starts[rows][:, None] + np.arange(dims)]


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); beyond ``magnitude`` that bound stands, so that every squared distance is a long."""
    bound = magnitude(vectors.shape[1])
    return np.clip(np.floor(vectors * scale), -bound, bound).astype(np.int64)


def floored_means(sums: np.ndarray, counts: list[int], before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every row, exact; rows without members keep what stood before."""
    out = before.copy()
    for k, n in enumerate(counts):
        if n:
            out[k] = [int(s) // n for s in sums[k]]
    return out


#: DuckDB: floor(a / b) of whole numbers, b above 0.
FLOOR_DIV = "CAST(({a} - ((({a}) % {b}) + {b}) % {b}) // {b} AS BIGINT)"
