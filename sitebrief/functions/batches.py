"""Column functions over Arrow batches, a few values at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES, MOST_ROWS = 1 << 20, 1024


def each(values: pa.Array, kind: pa.DataType, fn: Callable) -> pa.Array:
    """fn of every string (null as None), as an Arrow array.

    A batch can hold 10,000 long texts. Python objects, many times the size of Arrow's, exist for about ``MOST_BYTES`` of
    values and their results at a time (for a longer value alone), whatever the batch holds.
    """
    ends = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    at = np.arange(len(values))
    cuts = (np.flatnonzero((np.diff(ends // MOST_BYTES) > 0) | (np.diff(at // MOST_ROWS) > 0)) + 1).tolist()
    runs = [values.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(values)])]
    return pa.concat_arrays([pa.array([fn(v) for v in run.to_pylist()], kind) for run in runs])
