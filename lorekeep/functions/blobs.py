"""Vectors as little-endian float32 bytes, as other stores keep them. Whole columns are reinterpreted; no value is touched."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


@F.arrow_udf(T.BinaryType())
def to_blob(vectors: pa.Array) -> pa.Array:
    column = _plain(vectors).cast(pa.list_(pa.float32()))
    ends = column.offsets.to_numpy().astype(np.int64)
    data = column.values.to_numpy(zero_copy_only=False).astype("<f4")[ends[0] : ends[-1]]
    packed = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((ends - ends[0]) * 4), pa.py_buffer(data)])
    return pc.if_else(column.is_valid(), packed, pa.scalar(None, pa.large_binary())).cast(pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pa.Array) -> pa.Array:
    column = _plain(blobs).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = pa.array(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<f4") if data is not None else np.zeros(0, "<f4"), pa.float32())
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), values, mask=column.is_null())
