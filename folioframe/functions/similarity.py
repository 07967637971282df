"""Similarity measures between counts, shares, vectors and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.geometry import Box
from folioframe.functions.numeric import clamp


def count_similarity(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1)))


def ratio_similarity(a: Column, b: Column) -> Column:
    """One minus the relative difference; two empty values agree."""
    top = F.greatest(F.abs(a), F.abs(b), F.lit(1e-6))
    return F.when((a <= 0) & (b <= 0), F.lit(1.0)).otherwise(clamp(1.0 - F.abs(a - b) / top))


def min_max_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger, the variant of region matching and word groups."""
    return F.when((a <= 0) & (b <= 0), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(a, b)) / F.greatest(a, b, F.lit(1e-6))
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _cosine(product: Column, left: Column, right: Column) -> Column:
    return (
        F.when((left == 0) & (right == 0), F.lit(1.0))
        .when((left == 0) | (right == 0), F.lit(0.0))
        .otherwise(clamp(product / (left * right)))
    )


def vector_similarity(a: Column, b: Column) -> Column:
    """Clamped cosine over the common length, where two zero vectors agree."""
    shared = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(shared == 0, F.lit(0.0))
        .otherwise(_cosine(dot(left, right), norm(left), norm(right)))
    )


def grid_similarity(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """The same for whole-number grids of one size whose norms are known."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    product = F.aggregate(products, F.lit(0).cast("bigint"), lambda total, v: total + v)
    return _cosine(product.cast("double"), norm_a, norm_b)


def strict_cosine(a: Column, b: Column) -> Column:
    """Plain cosine: unequal length or a zero vector gives 0, and nothing is clamped."""
    left, right = norm(a), norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (left != 0) & (right != 0)
    return F.when(usable, dot(a, b) / (left * right)).otherwise(F.lit(0.0))


def box_similarity(a: Box, b: Box) -> Column:
    """Half position, three tenths size, two tenths area."""
    distance = F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))
    position = clamp(1.0 - distance / 0.75)
    size = (ratio_similarity(a.w, b.w) + ratio_similarity(a.h, b.h)) / 2
    return clamp(position * 0.50 + size * 0.30 + ratio_similarity(a.area, b.area) * 0.20)
