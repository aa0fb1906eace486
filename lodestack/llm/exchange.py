"""Many small (key, value) records shuffled as packed arrays.

A task sorts its records into buckets by key and sends one row of packed bytes for each bucket, so rows in
the shuffle are few. Callers drop what repeats within a batch, and send a key that many records share once;
so a hot key costs a record or two for each batch.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def pack(bucket: np.ndarray, arrays: Sequence[np.ndarray], deltas: Sequence[int] = ()) -> Iterator[pa.RecordBatch]:
    """Rows (bucket int, c0 binary, c1 binary, ...) of records dealt by bucket.

    Columns in deltas are sent as differences within a row, of records sorted by those columns: mostly zeros, which the
    shuffle's compression removes.
    """
    if not len(bucket):
        return
    order = np.lexsort([*[arrays[i] for i in reversed(deltas)], bucket]) if deltas else np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(b)]])
    columns = [pa.array(b[lo].astype(np.int32))]
    for i, a in enumerate(arrays):
        a = a[order]
        if i in deltas:
            step = a.copy()
            step[1:] -= a[:-1]
            step[lo] = a[lo]
            a = step
        raw, w = a.tobytes(), a.dtype.itemsize
        columns.append(pa.array([raw[x * w : y * w] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()))
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *[f"c{i}" for i in range(len(arrays))]])


def schema(n: int) -> str:
    return ", ".join(["bucket int", *[f"c{i} binary" for i in range(n)]])


def unpack(pdf, *dtypes, deltas: Sequence[int] = ()) -> list[np.ndarray]:
    """The arrays of a bucket that applyInPandas has gathered; a bucket without rows gives empty ones."""
    out = []
    for i, d in enumerate(dtypes):
        if i in deltas:
            out.append(np.concatenate([np.zeros(0, d), *[np.cumsum(np.frombuffer(x, d), dtype=d) for x in pdf[f"c{i}"]]]))
        else:
            out.append(np.frombuffer(b"".join(pdf[f"c{i}"]), d))
    return out


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each sorted record is in."""
    new = np.zeros(len(sorted_keys[0]), bool)
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)
