"""Vector arithmetic in double precision over float vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 if either is zero; inside the JVM."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(_sum(F.zip_with(a, b, lambda x, y: x * y)) / size)


def cosines(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The cosines of all rows with all queries, 0 where either is zero."""
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    size = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
    return np.divide(v @ q.T, size, out=np.zeros_like(size), where=size > 0)


def vector_from_json(text: Column) -> Column:
    return F.from_json(text, "array<float>")
