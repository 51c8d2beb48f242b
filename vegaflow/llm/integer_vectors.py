"""Vectors as whole numbers: floors of a multiple of each component, packed into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Components beyond are taken as the limit, and results that do not fit a long as the longest, so that no value ends a query.
LIMIT, MOST = 2.0**62, 2**63 - 1


def whole_components(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, floor(scale * x) as doubles) of the rows that are not null and hold finite numbers only."""
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            yield dim, at[ok], np.clip(np.floor(x[ok] * scale), -LIMIT, LIMIT)


def packed(x: np.ndarray) -> bytes:
    """Two bytes to a component where all fit, else eight."""
    small = not x.size or np.abs(x).max() <= 32767
    return x.astype("<i2" if small else "<f8").tobytes()


def unpacked(body: bytes, n: int, dim: int) -> np.ndarray:
    """(n, dim) doubles that are whole numbers."""
    return np.frombuffer(body, "<i2" if len(body) == 2 * n * dim else "<f8").reshape(n, dim).astype("f8")


def exact_in_doubles(dim: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products and squared distances of these rows are exact in double precision."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    return 4 * dim * most * most < 2.0**53


def as_integers(x: np.ndarray) -> np.ndarray:
    """Python integers, for components too large for doubles or longs."""
    out = np.empty(x.shape, object)
    out.ravel()[:] = list(map(int, x.ravel().tolist()))
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    """Longs; what is beyond is the longest."""
    if x.dtype == object:
        return np.array([max(-MOST - 1, min(MOST, int(v))) for v in x.ravel().tolist()], np.int64).reshape(x.shape)
    return x.astype(np.int64)
