"""Shared parts of the vector operators: rows that take part, NumPy views of Arrow lists, first entries of ordered pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False))


def real(df: DataFrame, column: str) -> str:
    """The type of a column's components: float stays as it is, every other number is widened to double."""
    kind = dict(df.dtypes)[column]
    return "float" if kind == "array<float>" else "double"


def matrices(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, matrix) for each length of vector among a list array without nulls."""
    sizes = np.diff(np.asarray(vectors.offsets).astype(np.int64))
    flat, begin = np.asarray(vectors.flatten()), np.cumsum(sizes) - sizes
    out = []
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        out.append((rows, flat[begin[rows][:, None] + np.arange(width)]))
    return out


def joined(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def leaders(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each group by descending score, then id; of entries equal in all three, one counts."""
    order = np.lexsort((ids, -scores, groups))
    g, s, i = groups[order], scores[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, g = order[new], g[new]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    return order[place < k]
