"""Affine maps as arrays in row order: six numbers in two dimensions, twelve in three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldmark.functions.text import _col


def _cells(m, d: int) -> list[list[Column]]:
    return [[F.element_at(_col(m), i * (d + 1) + j + 1) for j in range(d + 1)] for i in range(d)]


def identity(d: int) -> Column:
    return F.array(*[F.lit(float(i == j)) for i in range(d) for j in range(d + 1)])


def apply(m, point: list[Column]) -> list[Column]:
    """The image of a point."""
    return [sum((row[j] * p for j, p in enumerate(point)), row[-1]) for row in _cells(m, len(point))]


def concatenate(a, b, d: int) -> Column:
    """a after b."""
    x, y = _cells(a, d), _cells(b, d)
    return F.array(*[sum((x[i][k] * y[k][j] for k in range(d)), x[i][d] if j == d else F.lit(0.0)) for i in range(d) for j in range(d + 1)])


def invert(m, d: int) -> Column:
    """The inverse by cofactors; null if the determinant is 0."""
    a = _cells(m, d)
    if d == 2:
        det = a[0][0] * a[1][1] - a[0][1] * a[1][0]
        inv = [[a[1][1], -a[0][1]], [-a[1][0], a[0][0]]]
    else:
        minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
        det = sum((a[0][j] * minor(0, j) for j in range(3)), F.lit(0.0))
        inv = [[minor(j, i) for j in range(3)] for i in range(3)]
    linear = [[F.try_divide(c, det) for c in row] for row in inv]
    return F.array(*[linear[i][j] if j < d else -sum((linear[i][k] * a[k][d] for k in range(d)), F.lit(0.0)) for i in range(d) for j in range(d + 1)])


def merge(coarse: Column, roi: list[Column], fine: Column, d: int) -> Column:
    """Fine after coarse, with the origin of a region of interest in between."""
    shift = F.array(*[F.lit(float(i == j)) if j < d else -roi[i] for i in range(d) for j in range(d + 1)])
    return concatenate(fine, concatenate(shift, coarse, d), d)
