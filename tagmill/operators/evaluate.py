"""Metrics over a table of ``true_label, predicted_label``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.constants import NOISE_LABEL
from tagmill.storage import lookup_join, pair_with, settle


def pair_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """Rows per true and predicted label; everything else is computed from these."""
    return pairs.groupBy(*by, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    right = (F.col("true_label") == F.col("predicted_label")).cast("double")
    return pairs.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def all_labels(pairs: DataFrame) -> DataFrame:
    """Labels that are true or predicted somewhere, sorted."""
    return (
        pairs.select(F.col("true_label").alias("label"))
        .unionByName(pairs.select(F.col("predicted_label").alias("label")))
        .distinct()
        .orderBy("label")
    )


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(pairs: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support; an empty denominator gives 0."""
    return _per_class(pair_counts(pairs, *by), *by)


def _per_class(counts: DataFrame, *by: str) -> DataFrame:
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    as_true = counts.select(*by, F.col("true_label").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), hit.alias("h"))
    as_pred = counts.select(*by, F.col("predicted_label").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("h"))
    sums = as_true.unionByName(as_pred).groupBy(*by, "label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("_predicted"), F.sum("h").alias("_hits")
    )
    scored = sums.withColumn("precision", _ratio(F.col("_hits"), F.col("_predicted"))).withColumn(
        "recall", _ratio(F.col("_hits"), F.col("support"))
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1_score", f1).select(*by, "label", "precision", "recall", "f1_score", "support")


def weighted_scores(pairs: DataFrame, *by: str) -> DataFrame:
    """Averages weighted by support."""
    return _weighted(per_class(pairs, *by), *by)


def _weighted(classes: DataFrame, *by: str) -> DataFrame:
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1_score")],
        total.alias("support"),
    )


def macro_scores(pairs: DataFrame, *by: str) -> DataFrame:
    """Plain averages over classes."""
    return per_class(pairs, *by).groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1_score")], F.sum("support").alias("support")
    )


def confusion(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Counts of the true and predicted labels that occur together.

    With a table of ``labels``, counts for every two of them, zeros included.
    """
    counts = pair_counts(pairs)
    if labels is None:
        return counts
    grid = pair_with(labels.withColumnRenamed("label", "true_label"), labels.withColumnRenamed("label", "predicted_label"), "predicted_label")
    return lookup_join(grid, counts, ["true_label", "predicted_label"], "left").select(
        "true_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("n")
    )


def route_by_truth(truth: DataFrame, mapping: DataFrame, predictions: DataFrame) -> DataFrame:
    """Prediction of the subset that owns the true label; noise when there is none."""
    owned = lookup_join(truth, mapping.select(F.col("label").alias("true_label"), "subset_id"), "true_label", "left")
    return owned.join(predictions.select("row_id", "subset_id", "predicted_label"), ["row_id", "subset_id"], "left").withColumn(
        "predicted_label", F.coalesce("predicted_label", F.lit(NOISE_LABEL))
    )


def route_by_score(predictions: DataFrame) -> DataFrame:
    """Most probable non-noise prediction over all subsets; noise when all say noise.

    ``predictions`` has ``row_id, subset_id, predicted_label, max_probability``.
    """
    rank = F.struct(
        (F.col("predicted_label") != NOISE_LABEL).alias("known"), F.col("max_probability"), F.col("subset_id")
    )
    return predictions.groupBy("row_id").agg(F.max_by("predicted_label", rank).alias("predicted_label"))


def summary(pairs: DataFrame) -> DataFrame:
    """One row with accuracy and weighted scores."""
    counts = settle(pair_counts(pairs), "pairs")
    spread = counts.groupBy().agg(
        (F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    scores = _weighted(_per_class(counts))
    return spread.withColumn("_one", F.lit(1)).join(scores.withColumn("_one", F.lit(1)), "_one").drop("_one")


def comparison_table(pairs: DataFrame, *by: str) -> DataFrame:
    """Accuracy and weighted scores of several runs at once, one row each; ``by`` names the run."""
    counts = settle(pair_counts(pairs, *by), "pairs")
    right = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    shares = counts.groupBy(*by).agg((F.sum(right) / F.sum("n")).alias("accuracy"))
    return shares.join(_weighted(_per_class(counts, *by), *by), list(by))
