"""Vectors of whole numbers and their exact inner products, whatever the size of components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a score in a key, enough for products of the largest doubles.
DIGITS = 640
_LEAST, _MOST = -(2**63), 2**63 - 1


def usable(id_column: Column, vector: Column) -> Column:
    """Whether id and vector are there and no component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return id_column.isNotNull() & vector.isNotNull() & fine


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of the components, as doubles: a double holds them exactly where a long would clamp them."""
    return F.transform(vector, lambda x: _floor(F.lit(float(scale)) * x.cast("double")))


def _floor(x: Column) -> Column:
    whole = F.rint(x)
    return F.when(whole > x, whole - 1.0).otherwise(whole)


def spread(column: str, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(n)).cast("int")


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded with zeros."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.stack([np.asarray(v, np.float64) for v in vectors])
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact_products(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Inner products of a query with rows, or of queries with rows, exact for components up to ``top`` in size.

    Doubles do while no partial sum passes 2**53, longs while none passes 2**63; beyond that Python's integers do.
    """
    most = top * top * max(x.shape[-1], 1)
    if most < 2.0**52:
        return (x @ q if q.ndim == 1 else q @ x.T).astype(np.int64)
    if most < 2.0**62:
        q, x = q.astype(np.int64), x.astype(np.int64)
        return x @ q if q.ndim == 1 else q @ x.T
    whole = lambda a: np.array([int(v) for v in a.ravel()], object).reshape(a.shape)
    q, x = whole(q), whole(x)
    if q.ndim == 1:
        return np.array([sum((int(a) * int(b) for a, b in zip(row, q, strict=True)), 0) for row in x], object)
    return np.array([[sum((int(a) * int(b) for a, b in zip(row, other, strict=True)), 0) for row in x] for other in q], object).reshape(len(q), len(x))


def long_score(score) -> int:
    """The score, or the nearest long to it."""
    return min(max(int(score), _LEAST), _MOST)


def key_of_score(score) -> str:
    """A string that sorts as the score does."""
    return f"1{int(score):0{DIGITS}d}" if score >= 0 else f"0{10**DIGITS + int(score):0{DIGITS}d}"


def score_of_key(key: str) -> int:
    return int(key[1:]) - (0 if key[0] == "1" else 10**DIGITS)
