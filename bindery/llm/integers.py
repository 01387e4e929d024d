"""Embeddings as vectors of integers, which every sum and distance of is exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import stage


@dataclass(frozen=True)
class Scaled:
    """``rows`` (id, label, x array<long>), written; how many, how long each, and the largest absolute entry."""

    rows: DataFrame
    count: int
    dim: int
    most: int


def scaled(vectors: DataFrame, id_col: str, label_col: str | None, vector_col: str, scale: int, add: int = 0) -> Scaled:
    """Entries ``floor(scale * c) + add``. Rows whose vector is null, empty or holds null or non-finite entries are left out.

    Vectors of different lengths have no common parts or covariance and stop the job with an error.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(add))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = stage(vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("x")), "integers")
    size, high, low = F.size("x"), F.array_max("x"), F.array_min("x")
    n, least, dim, top, bottom = rows.agg(F.count("*"), F.min(size), F.max(size), F.max(high), F.min(low)).first()
    if least != dim:
        raise ValueError(f"vectors of {least} to {dim} entries in one table")
    return Scaled(rows, n, dim or 0, max(top or 0, -(bottom or 0)))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of an Arrow list column."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def sums(partial: DataFrame, size: int) -> np.ndarray:
    """Tasks' partial sums, rows of ``at`` and ``value``, added up: an array of ``size``, which is small by its definition."""
    kind = partial.schema["value"].dataType.simpleString()
    out = np.zeros(size, np.int64 if kind == "bigint" else np.float64)
    for at, value in partial.groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out
