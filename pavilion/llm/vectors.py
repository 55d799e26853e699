"""The table ``embeddings``: whole vectors as raw bytes, so that equal vectors are equal keys and tasks read them without copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def numbers(vectors: DataFrame, column: str = "embedding") -> tuple[Column, str]:
    """The vectors as arrays of floats or doubles, and the numpy type of their components."""
    kind = vectors.schema[column].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return F.col(column).cast("array<float>" if single else "array<double>"), "<f4" if single else "<f8"


def raw(column: pa.Array, kind: str) -> list[bytes | None]:
    """The components of each vector as bytes; None for a null vector and one with a null or non-finite component."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    lost = flat.is_null().to_numpy(zero_copy_only=False)
    flat = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + 0  # no negative zeros
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(lost | ~np.isfinite(flat))])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    data, width = memoryview(flat.astype(kind).tobytes()), np.dtype(kind).itemsize
    return [bytes(data[a * width : b * width]) if ok else None
            for a, b, ok in zip((ends - size).tolist(), ends.tolist(), usable.tolist())]


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), len(vectors[0]) // np.dtype(kind).itemsize).astype(np.float64)


def by_length(vectors: list[bytes]) -> list[np.ndarray]:
    """Places of the vectors of each length."""
    size = np.array([len(v) for v in vectors], np.int64)
    return [np.flatnonzero(size == n) for n in np.unique(size)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow; a zero row stays zero."""
    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(length > 0, length, 1)
