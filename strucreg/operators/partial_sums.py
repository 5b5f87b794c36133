"""Sums of fixed-size vectors computed inside the tasks.

Each task emits one vector per key, cut into chunks. All tasks' pieces of a chunk meet in one task that adds them as they
come, so its memory is a chunk per key whatever the number of tasks, and the driver sees each sum once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Numbers per row, and up to how many tasks the driver adds the vectors itself.
CHUNK = 1024
FEW_TASKS = 16
SCHEMA = "key int, chunk int, values array<double>"
ARROW_SCHEMA = pa.schema([("key", pa.int32()), ("chunk", pa.int32()), ("values", pa.list_(pa.float64()))])


def vector_rows(vectors: dict[int, np.ndarray]) -> pa.RecordBatch:
    pieces = [(k, c, np.ravel(v)[c * CHUNK : (c + 1) * CHUNK]) for k, v in vectors.items() for c in range(-(-v.size // CHUNK))]
    lengths = np.cumsum([0] + [p.size for _, _, p in pieces])
    flat = np.concatenate([p for _, _, p in pieces]) if pieces else np.zeros(0)
    lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.float64()))
    keys, chunks = (pa.array([p[i] for p in pieces], pa.int32()) for i in (0, 1))
    return pa.RecordBatch.from_arrays([keys, chunks, lists], schema=ARROW_SCHEMA)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a 2-D array, without a copy per row."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def sum_vectors(
    df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], few_tasks: bool = False
) -> dict[int, np.ndarray]:
    """Runs ``task`` on every partition and adds up its vectors by key.

    ``few_tasks`` skips the middle stage where the caller fixed the partition count at ``FEW_TASKS`` or less.
    """
    parts = df.mapInArrow(task, SCHEMA)
    if not few_tasks:
        # the number of partitions is left to the session; a chunk's pieces are all in one of them
        parts = parts.repartition("key", "chunk").mapInArrow(_added, SCHEMA)
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in parts.toArrow().to_batches():
        _add(total, batch)
    out: dict[int, list[np.ndarray]] = {}
    for (key, _), values in sorted(total.items()):
        out.setdefault(key, []).append(values)
    return {key: np.concatenate(pieces) for key, pieces in out.items()}


def _add(total: dict[tuple[int, int], np.ndarray], batch: pa.RecordBatch) -> None:
    for key, chunk, values in zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist(), batch.column("values")):
        v = values.values.to_numpy(zero_copy_only=False)
        total[key, chunk] = total[key, chunk] + v if (key, chunk) in total else v.copy()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        _add(total, batch)
    for (key, chunk), values in total.items():
        lists = pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values, pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([chunk], pa.int32()), lists], schema=ARROW_SCHEMA)
