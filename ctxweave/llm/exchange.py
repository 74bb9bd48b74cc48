"""Shuffling numpy arrays as a few large binary rows.

A map task sends each of R ranges one row with its columns as raw bytes, and the
task that owns the range reads them back as arrays. For data of some bytes a record
this costs far less than one row a record. R follows spark.sql.shuffle.partitions, so
a range stays as large as a shuffle partition at every size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def scatter(r: np.ndarray, cols: dict[str, np.ndarray], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """One row for each range (several where a range has over `most` records)."""
    order = np.argsort(r, kind="stable")
    rs = r[order]
    sorted_cols = {k: v[order] for k, v in cols.items()}
    cuts = np.flatnonzero(np.diff(rs)) + 1
    bounds = np.concatenate(([0], cuts, [len(rs)])) if len(rs) else np.zeros(1, np.int64)
    ids, blobs = [], {k: [] for k in cols}
    for a, b in zip(bounds[:-1], bounds[1:]):
        for x in range(int(a), int(b), most):
            y = min(x + most, int(b))
            ids.append(int(rs[x]))
            for k, v in sorted_cols.items():
                blobs[k].append(v[x:y].tobytes())
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(v, pa.binary()) for v in blobs.values())], names=["r", *blobs])


def gather(table: pa.Table, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The records of all rows, joined."""
    return {k: np.concatenate([np.frombuffer(x, kind) for x in table.column(k).to_pylist() if x is not None] or [np.zeros(0, kind)]) for k, kind in kinds.items()}
