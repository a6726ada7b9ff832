"""Vector columns held as arrays; arithmetic in double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(vector), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    # An array of one element holds the norm, so that it is computed once per vector.
    scaled = F.transform(F.array(norm(vector)), lambda n: F.transform(doubles(vector), lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.get(scaled, F.lit(0))
