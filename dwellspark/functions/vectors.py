"""Vectors as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)))


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def shifted_cosine(c: Column) -> Column:
    """Similarity of texts for ranking: (c + 1) / 2 within 0 and 1."""
    return F.least(F.greatest((c + 1) / 2, F.lit(0.0)), F.lit(1.0))


def clipped_cosine(c: Column) -> Column:
    """Similarity of texts for answers: c within 0 and 1."""
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def top2(similarities: Column) -> Column:
    """0.7 of the best and 0.3 of the second (the best again, if there is one alone)."""
    s = F.sort_array(similarities, asc=False)
    return 0.7 * F.get(s, F.lit(0)) + 0.3 * F.coalesce(F.get(s, F.lit(1)), F.get(s, F.lit(0)))
