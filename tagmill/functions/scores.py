"""Class-probability columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.constants import PROXY_REST, PROXY_TOP


def entropy_bits(probabilities: Column) -> Column:
    """Shannon entropy in bits; zero probabilities add nothing."""
    parts = F.transform(probabilities, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def proxy_probabilities(predicted: Column, labels: Column) -> Column:
    """Probabilities for a model that gives only a label: a fixed share to that
    label, the rest spread evenly; all zero when the label is unknown."""
    rest = F.lit(PROXY_REST) / (F.size(labels) - 1)
    known = F.array_contains(labels, predicted)
    return F.transform(
        labels,
        lambda one: F.when(~known, F.lit(0.0)).when(one == predicted, F.lit(PROXY_TOP)).otherwise(rest),
    )


def top_label(probabilities: Column, labels: Column) -> Column:
    """Label at the first maximum."""
    where = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(labels, where)


def softmax(values: Column) -> Column:
    # Arrays of one element hold what every element needs, so that it is computed once.
    shifted = F.transform(F.array(F.array_max(values)), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    total = F.transform(shifted, lambda row: F.struct(row.alias("row"), F.aggregate(row, F.lit(0.0), lambda acc, x: acc + x).alias("sum")))
    return F.get(F.transform(total, lambda s: F.transform(s["row"], lambda v: v / s["sum"])), F.lit(0))
