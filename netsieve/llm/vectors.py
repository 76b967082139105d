"""Helpers for embedding tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.shingles import _stream

MAX = 1e300


def usable(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of float as given, else of double) of the vectors that have
    an id and only finite components, one of them not 0."""
    kind = dict(embeddings.dtypes)[vec_col]
    v = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= MAX))
    return v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column whose lists are of one length."""
    a = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def gaussian(rows: int, cols: int, salt: int) -> np.ndarray:
    """A reproducible (rows, cols) matrix of standard normal numbers."""
    u = _stream(2 * rows * cols, salt << 32)
    a, b = (u.astype(np.float64) / 2.0 ** 64).reshape(2, rows, cols)
    return np.sqrt(-2 * np.log(a + 1e-18)) * np.cos(2 * np.pi * b)
