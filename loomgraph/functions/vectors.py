"""Vector math: JVM expressions for single pairs, an Arrow UDF for query-to-table scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """v / |v|; null for a null or zero vector."""
    c = _c(a)
    return F.when(norm(c) > 0, F.transform(c, lambda x: x.cast("double") / norm(c)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null when either vector is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def round3(sim: Column) -> Column:
    """Three decimals, without a negative zero."""
    return F.round(sim, 3) + F.lit(0.0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column (no nulls, equal lengths) as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Row-normalized copy; zero rows become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def score_against(query: list[float]):
    """Arrow UDF: cosine of each vector with one query vector. Null vectors score null and
    zero vectors NaN. The column is read as one flat buffer, so the cost per row is a
    matrix-vector product rather than a lambda per element."""
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)

    def score(vec: pa.Array) -> pa.Array:
        present = vec.is_valid()
        sims = unit_rows(matrix(vec.drop_null())) @ q if present.true_count else np.empty(0)
        out = np.full(len(vec), np.nan)
        mask = present.to_numpy(zero_copy_only=False)
        out[mask] = sims
        return pa.array(out, mask=~mask)

    return F.arrow_udf(score, "double")
