"""Vector expressions. Interpreted per element: use them on few rows and let
``operators.similarity`` do the bulk scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import _c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - cosine distance; NULL for a zero vector instead of NaN."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def dimension_fault(vector: Column | str, dimension: int) -> Column:
    """Why a vector cannot be stored or searched; NULL when it can."""
    v = _c(vector)
    return (
        F.when(v.isNull(), F.lit("missing"))
        .when(F.size(v) != dimension, F.concat(F.lit("dimension "), F.size(v).cast("string")))
        .when(norm(v) == 0, F.lit("zero norm"))
    )
