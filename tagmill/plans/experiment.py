"""Training sizes compared on one labelled table."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.constants import EXPERIMENT_SIZES
from tagmill.operators import evaluate
from tagmill.operators.sampling import experiment_splits
from tagmill.options import Options
from tagmill.plans.active import run_active
from tagmill.plans.initial import run_initial
from tagmill.plans.training import score
from tagmill.storage import settle


def run_experiments(
    spark: SparkSession, rows: DataFrame, run_dir: str, encoder, judge, options: Options = Options(), sizes=EXPERIMENT_SIZES
) -> DataFrame:
    """One line per training size: loop counts and scores on its pool rows.

    Rows are routed by their true label, as the published figures are.
    """
    splits = settle(experiment_splits(rows, options.fallback_classes, sizes, options.seed), "splits")
    lines = []
    for size in sizes:
        part = splits.where(F.col("per_class") == size).drop("per_class")
        train, rest = part.where("role = 'train'"), part.where("role = 'pool'")
        parts = run_initial(spark, train, f"{run_dir}/size={size}/initial", encoder, judge, options)
        loop = run_active(spark, parts, rest, f"{run_dir}/size={size}/active", encoder, judge, options)
        vectors = _vectors(rest, f"{run_dir}/size={size}/scores", encoder, parts.run_dir, loop.run_dir)
        predictions = score(vectors, parts.models, parts.weights, parts.vocabulary, options)
        truth = rest.select(F.col("row_id").cast("string").alias("row_id"), F.col("label").alias("true_label"))
        routed = evaluate.route_by_truth(truth, parts.mapping, predictions)
        counts = loop.history.agg(
            F.count(F.lit(1)).alias("iterations"), F.sum("validated_samples").alias("validated_samples")
        )
        line = evaluate.summary(routed).withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one")
        lines.append(line.drop("_one").withColumn("samples_per_class", F.lit(size)).withColumn("converged", F.lit(loop.stopped == "converged")))
    return reduce(DataFrame.unionByName, lines)


def _vectors(rows: DataFrame, run_dir: str, encoder, *known: str) -> DataFrame:
    from tagmill.plans.initial import embed

    named = rows.select(F.col("row_id").cast("string").alias("row_id"), "text")
    return settle(embed(named, run_dir, encoder, "encoder", "0", known), "vectors").select("row_id", "text", "vector")
