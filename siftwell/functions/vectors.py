"""Column functions on embedding arrays, and the block kernel the searches share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def all_finite(a: Column) -> Column:
    return F.forall(as_double(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def valid_embedding(a: Column, dim: int | None = None) -> Column:
    """Non-empty, of the wanted size, finite, and not all zero."""
    ok = a.isNotNull() & (F.size(a) > 0) & all_finite(a) & (norm(a) > 0)
    if dim is not None:
        ok = ok & (F.size(a) == dim)
    return F.coalesce(ok, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine01(a: Column, b: Column) -> Column:
    """(cos + 1) / 2 within [0, 1]; 0 for null, empty, unequal, non-finite or zero vectors."""
    usable = valid_embedding(a) & valid_embedding(b) & (F.size(a) == F.size(b))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1.0) * 0.5))
    return F.when(usable, value).otherwise(F.lit(0.0))


def similarity_from_distance(distance: Column) -> Column:
    """1 - distance, and 0 beyond distance 1."""
    return F.when(distance <= 1.0, 1.0 - distance).otherwise(F.lit(0.0))


def metric_score(a: Column, b: Column, metric: str) -> Column:
    """Larger is nearer, for COSINE, DOT_PRODUCT and EUCLIDEAN (negated distance)."""
    if metric == "COSINE":
        return cosine(a, b)
    if metric == "DOT_PRODUCT":
        return dot(a, b)
    if metric == "EUCLIDEAN":
        squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
        return -F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    raise ValueError(f"unknown metric {metric}")


def to_matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def block_scores(queries: np.ndarray, block: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Scores of a query block against a vector block, larger nearer; unusable rows score -inf."""
    with np.errstate(all="ignore"):
        if metric == "EUCLIDEAN":
            squares = (queries**2).sum(1)[:, None] + (block**2).sum(1)[None, :] - 2.0 * queries @ block.T
            scores = -np.sqrt(np.maximum(squares, 0.0))
        else:
            scores = queries @ block.T
            if metric == "COSINE":
                scores = scores / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None, :])
    scores[~np.isfinite(scores)] = -np.inf
    return np.round(scores, digits)
