"""Histories of the learning loop.

A history has one row per iteration of a run, so windows over a run are short; runs
are told apart by the ``by`` columns.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def iteration_metrics(log: DataFrame, *by: str) -> DataFrame:
    """Judged rows, valid rows and their share per iteration."""
    return (
        log.groupBy(*by, "iteration")
        .agg(F.count(F.lit(1)).alias("total_validated"), F.count_if("is_valid").alias("valid_samples"))
        .withColumn("validation_rate", F.coalesce(F.try_divide("valid_samples", "total_validated"), F.lit(0.0)))
    )


def performance_stats(history: DataFrame, *by: str) -> DataFrame:
    total = F.sum("iteration_time")
    return history.groupBy(*by).agg(
        total.alias("total_processing_time"),
        F.avg("iteration_time").alias("average_iteration_time"),
        F.min("iteration_time").alias("min_iteration_time"),
        F.max("iteration_time").alias("max_iteration_time"),
        F.count(F.lit(1)).alias("total_iterations"),
        F.coalesce(F.try_divide(F.sum("validated_samples"), total), F.lit(0.0)).alias("validation_efficiency"),
    )


def retrain_history(fits: DataFrame, *by: str) -> DataFrame:
    """Classifiers retrained per iteration, of all there are."""
    done = fits.groupBy(*by, "iteration").agg(
        F.count_distinct(F.when(F.col("retrained"), F.col("subset_id"))).alias("retrained_classifiers"),
        F.count_distinct("subset_id").alias("total_classifiers"),
    )
    return done.where(F.col("retrained_classifiers") > 0)


def stop_points(history: DataFrame, *by: str, mode: str = "informative_only", all_predicted: int = 3) -> DataFrame:
    """Mode of each iteration and whether the run stops after it.

    The first iteration without a prediction ends the informative phase for good.
    ``informative_only`` stops there; otherwise that iteration is the first of
    ``all_predicted`` and the last of them stops the run.
    """
    run = Window.partitionBy(*by)
    first = F.min(F.when(F.col("predictions_made") == 0, F.col("iteration"))).over(run)
    extra = 0 if mode == "informative_only" else all_predicted - 1
    return (
        history.withColumn("_first", first)
        .withColumn("phase", F.when(F.col("iteration") > F.col("_first"), "all_predicted").otherwise("informative"))
        .withColumn("empty_count", F.greatest(F.coalesce(F.col("iteration") - F.col("_first") + 1, F.lit(0)), F.lit(0)))
        .withColumn("stops", F.coalesce(F.col("iteration") == F.col("_first") + extra, F.lit(False)))
        .drop("_first")
    )


def converged(history: DataFrame, *by: str, min_gain: float = 0.01) -> DataFrame:
    """True when the last three rates are all below ``min_gain`` or nothing was validated."""
    last = Window.partitionBy(*by).orderBy("iteration").rowsBetween(-2, 0)
    rates = F.count(F.lit(1)).over(last) == 3
    low = F.max("validation_rate").over(last) < min_gain
    return history.withColumn("converged", (rates & low) | (F.col("validated_samples") == 0))


def retrain_due(history: DataFrame, *by: str, threshold: int = 100) -> DataFrame:
    """True when the running total passes a multiple of ``threshold``."""
    upto = Window.partitionBy(*by).orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("validated_samples").over(upto)
    out = history.withColumn("cumulative_validated", total)
    before = F.col("cumulative_validated") - F.col("validated_samples")
    return out.withColumn("due", F.floor(F.col("cumulative_validated") / threshold) > F.floor(before / threshold))
