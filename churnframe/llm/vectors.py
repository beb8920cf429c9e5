"""Integer vectors from an embedding column, for the operators on vectors.

A component x becomes floor(scale * x), x as a double, held within +-``bound``
(a defined result for absurd values: products and their sums then stay within
64 bits).  A vector travels as little-endian 32-bit integers, so vectors may
differ in length; a shorter one counts as padded with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C

EXACT = 1 << 53  # integers below are exact as doubles


def integer_vectors(df: DataFrame, vector_col: str, scale: float, bound: int) -> DataFrame:
    """The rows of ``df`` whose vector is not NULL and has no NULL or
    non-finite component: columns but the vector, then ``v`` (binary)."""
    kept = [c for c in df.columns if c != vector_col]
    doubles = F.col(C.quoted(vector_col)).cast("array<double>")
    rows = df.select(*[F.col(C.quoted(c)) for c in kept], doubles.alias("vector")).where("vector IS NOT NULL")
    schema = T.StructType([*(rows.schema[c] for c in kept), C.field("v", "binary")])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                column = batch.column("vector")
                ends = np.asarray(column.offsets) - column.offsets[0].as_py()
                flat = column.flatten()
                x = flat.to_numpy(zero_copy_only=False)  # NULL as NaN
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
                good = bad[ends[1:]] == bad[ends[:-1]]
                with np.errstate(invalid="ignore", over="ignore"):
                    floors = np.clip(np.floor(x * scale), -bound, bound)
                ints = np.where(np.isfinite(floors), floors, 0).astype("<i4")
                v = [ints[a:b].tobytes() for a, b, ok in zip(ends[:-1], ends[1:], good) if ok]
                left = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*(left.column(c) for c in kept), pa.array(v, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` components, shorter vectors padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    if vectors and len({len(v) for v in vectors}) == 1:
        flat = np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), -1)
        out[:, : flat.shape[1]] = flat
    else:
        for i, v in enumerate(vectors):
            out[i, : len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``: as
    doubles where every partial sum is an exact double, else as integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
