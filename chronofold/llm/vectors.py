"""Decoding of vector columns to fixed-width binary, so that tasks stack them without copies per value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): vec is the components as little-endian doubles.

    vec is null for a null vector, an empty one, and one that holds a null or non-finite component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            col = batch.column("v")
            if pa.types.is_list(col.type) and not col.null_count and not col.values.null_count and len(col):
                flat, offsets = np.asarray(col.values, dtype="<f8"), np.asarray(col.offsets)
                good = np.isfinite(flat)
                for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                    out.append(flat[i:j].tobytes() if j > i and good[i:j].all() else None)
            else:
                for x in col.to_pylist():
                    v = None if not x or None in x else np.array(x, dtype="<f8")
                    out.append(v.tobytes() if v is not None and np.isfinite(v).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, vec binary")


def stack(col) -> np.ndarray:
    """Rows of equal width as a matrix of doubles."""
    return np.frombuffer(b"".join(col), dtype="<f8").reshape(len(col), -1)
