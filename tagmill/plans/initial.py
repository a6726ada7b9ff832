"""From labelled seed rows to subsets, models and label descriptions."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.operators import features, judge as judging, labelspace, stats
from tagmill.operators.cleaning import clean_rows
from tagmill.options import Options
from tagmill.plans.training import Trained, train_subsets
from tagmill.sources import state
from tagmill.storage import settle


@dataclass
class Components:
    """What initial training leaves behind; ``labelled`` has ``row_id, text, label,
    vector``."""

    run_dir: str
    labelled: DataFrame
    mapping: DataFrame
    descriptions: DataFrame
    trained: Trained | None
    models: dict
    weights: DataFrame | None
    models_path: str = ""
    vocabulary: DataFrame | None = None


def embed(rows: DataFrame, run_dir: str, encoder, model: str, part: str, known=()) -> DataFrame:
    """Rows with ``vector``; new vectors are added to the run's cache, which is read
    one row per content key, so a repeated part does no harm. ``known`` names further runs
    whose vectors are used too; nothing is written there."""
    spark = rows.sparkSession
    caches = [state.read_appended(spark, folder, "vectors", features.EMPTY_CACHE).drop("iteration") for folder in (run_dir, *known)]
    cache = reduce(DataFrame.unionByName, caches)
    encoded, fresh = features.embed_texts(rows, cache, encoder, model)
    fresh.write.mode("append").parquet(f"{run_dir}/vectors/iteration={part}")
    return encoded.withColumnRenamed("embedding", "vector").drop("key")


def split_labels(seed: DataFrame, run_dir: str, encoder, model: str, options: Options) -> DataFrame:
    """Mapping from the vectors of the label names."""
    names = stats.distinct_labels(seed).select("label", F.col("label").alias("text"))
    vectors = embed(names, run_dir, encoder, model, "-1").select("label", "vector")
    if options.reduced_dims:
        vectors = labelspace.reduce_dims(vectors, options.reduced_dims)
    return settle(labelspace.greedy_subsets(vectors, options.subset_size), "mapping")


def run_initial(
    spark: SparkSession, rows: DataFrame, run_dir: str, encoder, judge=None, options: Options = Options(), model: str = "encoder"
) -> Components:
    """Clean, embed, split the labels, train every subset, describe the labels, save."""
    kept, rejected = clean_rows(rows.select("row_id", "text", "label"))
    seed = settle(kept.withColumn("row_id", F.concat(F.lit("seed:"), F.col("row_id").cast("string"))), "seed")
    labelled = settle(embed(seed, run_dir, encoder, model, "0"), "labelled")
    mapping = split_labels(seed, run_dir, encoder, model, options)
    trained = train_subsets(labelled, mapping, options)
    descriptions = settle(
        judging.describe_labels(seed, seed, judge, options.description_examples, options.seed), "descriptions"
    )
    models_path = f"{run_dir}/models/iter=0"
    state.save_models(spark, trained.models, models_path, trained.kind, trained.weights, trained.vocabulary)
    state.save_mapping(mapping, f"{run_dir}/mapping")
    state.save_state(
        run_dir,
        0,
        labelled=labelled,
        mapping=mapping,
        descriptions=descriptions,
        rejected=rejected,
        fit_log=trained.log,
        training_stats=trained.stats,
        training_report=trained.report,
        label_distribution=trained.distribution,
        seed_stats=stats.seed_stats(seed),
    )
    return Components(run_dir, labelled, mapping, descriptions, trained, trained.models, trained.weights, models_path, trained.vocabulary)


def load_components(spark: SparkSession, run_dir: str) -> Components:
    """Components of a finished initial run."""
    _, tables = state.load_state(spark, run_dir, 0)
    models_path = f"{run_dir}/models/iter=0"
    models, weights = state.load_models(spark, models_path)
    vocabulary = state.load_vocabulary(spark, models_path)
    return Components(run_dir, tables["labelled"], tables["mapping"], tables["descriptions"], None, models, weights, models_path, vocabulary)
