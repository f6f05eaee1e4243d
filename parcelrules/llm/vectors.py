"""Vector columns as numpy: whole components, and the rows that have any."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 256


def whole_components(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(256 * x) of a column of double lists, flat; the rows' offsets; and which rows are sound.

    A row is sound if it is no null and none of its components is null, NaN or infinite.
    """
    n = len(column)
    if not n:
        return np.zeros(0), np.zeros(1, np.int64), np.zeros(0, bool)
    column = column.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = values.to_numpy(zero_copy_only=False)            # nulls come as NaN
    offsets = offsets - offsets[0]
    ok = np.isfinite(flat)
    bad = np.append(0, np.cumsum(~ok))
    sound = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(column.is_null())
    return np.floor(np.where(ok, flat, 0.0) * SCALE), offsets, sound


def pick(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The components of ``rows``, all of ``size``, as a matrix."""
    return flat[offsets[rows][:, None] + np.arange(size)]
