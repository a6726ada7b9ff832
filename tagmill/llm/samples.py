"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.storage import lookup_join

SPARE = 1.5


def bounded(rows: DataFrame, by: str, key: str, quota: int) -> DataFrame:
    """At most ``quota`` rows per value of ``by``, those with the lowest hash of ``key``.

    A share of each value's rows is taken by hash first, so only about ``SPARE * quota`` rows
    of a value are ranked, however many it has. Rows without a value are left out.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    near = lookup_join(rows.withColumn("_h", place), counts, by).where(F.col("_h") * F.col("_n") <= F.lit(SPARE * quota * (1 << 30)))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", key)))
    return ranked.where(F.col("_r") <= quota).drop("_h", "_n", "_r")
