"""Dense count tables gathered from all tasks, of a size fixed by the model.

A task sends its counts as blocks of ``BLOCK`` slots; the blocks of one place
are summed in two steps (first by place and a salt, then by place), so that no
task reads one row per map task of a large cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14
SCHEMA = "block int, salt int, n binary"
_ARROW = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("n", pa.binary())])
SALTS = 64


def blocks(counts: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """The non-empty blocks of one task's counts."""
    for k in range(0, len(counts), BLOCK):
        part = counts[k:k + BLOCK].astype("<i8")
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([salt % SALTS], pa.int32()),
                                              pa.array([part.tobytes()], pa.binary())], schema=_ARROW)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, first = None, None
    for b in batches:
        first = b.slice(0, 1) if first is None and b.num_rows else first
        for x in b.column("n"):
            n = np.frombuffer(x.as_buffer(), "<i8")
            total = n.copy() if total is None else total + n
    yield pa.RecordBatch.from_arrays([first.column("block"), first.column("salt"), pa.array([total.tobytes()], pa.binary())], schema=_ARROW)


def gathered(parts: DataFrame, size: int) -> np.ndarray:
    """The summed counts: ``size`` slots, at most size / BLOCK rows to the driver."""
    by_salt = parts.groupBy("block", "salt").applyInArrow(_sum, SCHEMA)
    rows = by_salt.withColumn("salt", F.lit(0)).groupBy("block").applyInArrow(_sum, SCHEMA).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        n = np.frombuffer(bytes(r.n), "<i8")
        out[r.block * BLOCK:r.block * BLOCK + len(n)] = n
    return out
