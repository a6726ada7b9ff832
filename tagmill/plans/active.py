"""The learning loop: score a batch, judge the uncertain rows, grow, retrain.

Every iteration reads written tables and writes its own, so plans stay short and a
stopped run continues after its last complete iteration.
"""

import math
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.operators import judge as judging, models, progress
from tagmill.operators.cleaning import accepted, clean_rows, drop_noise
from tagmill.operators.mapping import attach_subset
from tagmill.operators.sampling import batch_slice, number_rows
from tagmill.options import Options
from tagmill.plans.initial import Components, embed, load_components
from tagmill.plans.training import Trained, score, train_subsets
from tagmill.sources import state
from tagmill.sources.vectorindex import VectorIndex
from tagmill.storage import settle, temporary

HISTORY = (
    "batch_size long, predictions_made long, informative_samples long, judged long, validated_samples long, "
    "retrained_classifiers long, cumulative_validated long, validation_rate double, iteration_time double"
)
VALIDATED = "row_id string, text string, label string, vector array<float>, confidence double, source string"
LOG = "row_id string, predicted_label string, is_valid boolean, confidence double, error string, cached boolean"
FITS = "subset_id string, retrained boolean, rows long"


@dataclass
class Outcome:
    """Result tables of a loop."""

    run_dir: str
    history: DataFrame
    validated: DataFrame
    verdicts: DataFrame
    fits: DataFrame
    performance: DataFrame
    stopped: str
    trained: Trained | None


def choose(predictions: DataFrame, phase: str, k: int | None) -> DataFrame:
    """Rows to judge: the ``k`` most uncertain, or in the later phase and without ``k`` all of them."""
    known = drop_noise(predictions).select("row_id", "subset_id", "predicted_label", "uncertainty")
    return models.most_uncertain(known, k) if phase == "informative" and k is not None else known


def all_labelled(parts: Components, validated: DataFrame) -> DataFrame:
    """Seed and validated rows; a pool row counts once per label it got."""
    grown = validated.select(
        F.concat_ws(":", F.lit("pool"), "row_id", "label").alias("row_id"), "text", "label", "vector"
    )
    return parts.labelled.select("row_id", "text", "label", "vector").unionByName(grown)


def example_index(spark, parts: Components, run_dir: str, options: Options) -> VectorIndex | None:
    """The stored index of the rows that serve as examples, if options ask for it; written once per loop."""
    if not options.example_index:
        return None
    index = VectorIndex(f"{run_dir}/examples")
    if not index.complete(spark):
        index.create(parts.labelled.withColumnRenamed("row_id", "item_id"), options.similar_examples)
    return index


def run_iteration(spark, parts: Components, pool, size: int, run_dir, at: int, phase: str, encoder, judge, options, model, done: int):
    """One iteration over ``size`` pool rows; returns its history values and the components
    to go on with, and writes its tables."""
    start = time.time()
    with temporary(spark, "iteration"):
        batch = batch_slice(pool, size, at - 1)
        rows = settle(embed(batch.select("row_id", "text"), run_dir, encoder, model, f"{at}", (parts.run_dir,)), "batch")
        size = rows.count()
        values = {"batch_size": size, "predictions_made": 0, "informative_samples": 0, "judged": 0, "validated_samples": 0}
        values["validation_rate"] = 0.0
        if size:
            predictions = settle(drop_noise(score(rows, parts.models, parts.weights, parts.vocabulary, options)), "predictions")
            chosen = settle(choose(predictions, phase, options.samples_per_iteration), "chosen")
            asked = chosen.join(rows, "row_id")
            cache = judging.verdict_cache(f"{run_dir}/verdicts", options.keep_examples)._replace(before=at)
            verdicts, fresh = judging.judge_batch(
                asked, cache, parts.labelled, parts.descriptions, judge, options.similar_examples,
                keep_examples=options.keep_examples, log=f"{run_dir}/requests/iteration={at}",
                index=example_index(spark, parts, run_dir, options),
            )
            verdicts = settle(verdicts, "judged")
            cache.add(fresh, at)
            log = verdicts.select("row_id", "predicted_label", "is_valid", "confidence", "error", "cached")
            state.append_rows(log, run_dir, "log", at)
            new = accepted(verdicts, options.confidence_threshold).select(
                "row_id", "text", F.col("predicted_label").alias("label"), "vector", "confidence", F.lit("judge").alias("source")
            )
            state.append_rows(new, run_dir, "validated", at)
            good = F.col("is_valid") & (F.col("confidence") >= options.confidence_threshold)
            counts = verdicts.agg(
                F.count(F.lit(1)).alias("judged"), F.count_if(good).alias("validated"), F.count_if("is_valid").alias("valid")
            ).first()
            values["predictions_made"] = predictions.count()
            values["informative_samples"] = values["judged"] = counts["judged"]
            values["validated_samples"] = counts["validated"]
            values["validation_rate"] = counts["valid"] / counts["judged"] if counts["judged"] else 0.0
    values["cumulative_validated"] = done + values["validated_samples"]
    values["retrained_classifiers"] = 0
    before = done // options.retrain_threshold
    if values["validated_samples"] and values["cumulative_validated"] // options.retrain_threshold > before:
        parts, values["retrained_classifiers"] = retrain(spark, parts, run_dir, at, options)
    values["iteration_time"] = time.time() - start
    return values, parts


def last_fits(spark: SparkSession, run_dir: str, upto: int) -> DataFrame:
    """Labelled rows each subset had when it was last fitted."""
    fits = state.read_appended(spark, run_dir, "fits", FITS, upto).where("retrained")
    return fits.groupBy("subset_id").agg(F.max_by("rows", "iteration").alias("rows"))


def labelled_rows(spark, parts: Components, run_dir: str, at: int) -> tuple[DataFrame, DataFrame]:
    """All labelled rows up to an iteration, and their ids by subset."""
    validated = state.read_appended(spark, run_dir, "validated", VALIDATED, at)
    labelled = settle(all_labelled(parts, validated), "labelled")
    return labelled, attach_subset(labelled.select("row_id", "label"), parts.mapping)


def refitted(spark, parts: Components, labelled: DataFrame, chosen, options: Options, path: str) -> Components:
    """The components with the chosen subsets fitted anew; all models are saved under ``path``."""
    trained = train_subsets(labelled, parts.mapping, options, only=chosen)
    weights = parts.weights
    if weights is not None:
        kept = weights.where(~F.col("subset_id").isin(list(trained.fitted)))
        weights = settle(kept.unionByName(trained.weights), "models")
    vocabulary = trained.vocabulary
    if vocabulary is not None and parts.vocabulary is not None:
        new = F.col("subset_id").isin(list(trained.fitted))
        vocabulary = settle(parts.vocabulary.where(~new).unionByName(vocabulary.where(new)), "vocabulary")
    models_ = {**parts.models, **trained.models}
    state.save_models(spark, models_, path, trained.kind, weights, vocabulary)
    return replace(parts, trained=trained, models=models_, weights=weights, models_path=path, vocabulary=vocabulary)


def fit_rows(rows: DataFrame, parts: Components) -> DataFrame:
    """Rows per subset and whether the latest training fitted it."""
    now = rows.groupBy("subset_id").agg(F.count(F.lit(1)).alias("rows"))
    return now.select("subset_id", F.col("subset_id").isin(list(parts.trained.fitted)).alias("retrained"), "rows")


def retrain(spark, parts: Components, run_dir: str, at: int, options: Options) -> tuple[Components, int]:
    """Refit subsets that gained rows, from all labelled rows; also returns their number."""
    labelled, rows = labelled_rows(spark, parts, run_dir, at)
    due = rows.select("subset_id").distinct() if options.retrain_all else models.needs_retrain(rows, last_fits(spark, run_dir, at - 1))
    chosen = sorted(r["subset_id"] for r in due.select("subset_id").collect())
    if not chosen:
        return parts, 0
    parts = refitted(spark, parts, labelled, chosen, options, f"{run_dir}/models/iteration={at}-{uuid.uuid4().hex}")
    state.append_rows(fit_rows(rows, parts), run_dir, "fits", at)
    return parts, len(parts.trained.fitted)


def saved(spark, parts: Components, run_dir: str, at: int) -> None:
    """Mark an iteration as complete; its models are named, so that a stopped loop goes on with them."""
    path = spark.createDataFrame([(parts.models_path,)], "path string")
    state.save_state(run_dir, at, mapping=parts.mapping, models=path)


def pool_table(spark, pool: DataFrame, run_dir: str) -> DataFrame:
    """The cleaned, numbered pool; written once per loop."""
    path = f"{run_dir}/pool"
    if not state.exists(spark, f"{path}/_SUCCESS"):
        clean, _ = clean_rows(pool.select("row_id", "text"), ("text",))
        numbered = number_rows(clean.select("row_id", "text"), "row_id")
        numbered.withColumn("row_id", F.col("row_id").cast("string")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_active(
    spark: SparkSession,
    components: Components | str,
    pool: DataFrame,
    run_dir: str,
    encoder,
    judge,
    options: Options = Options(),
    model: str = "encoder",
) -> Outcome:
    """Iterate over the pool until it is exhausted, converged or out of iterations.

    ``pool`` has ``row_id, text``. An existing ``run_dir`` is continued with the pool and the models
    of its last complete iteration. The fits at the end go to ``run_dir/final`` and do not touch the loop.
    """
    parts = load_components(spark, components) if isinstance(components, str) else components
    table = pool_table(spark, pool, run_dir)
    size = options.batch_size or max(1, math.ceil(options.batch_share * table.count()))
    at = state.latest_iteration(spark, run_dir)
    if at is None:
        at = 0
        sizes = attach_subset(parts.labelled, parts.mapping).groupBy("subset_id").agg(F.count(F.lit(1)).alias("rows"))
        state.append_rows(sizes.select("subset_id", F.lit(True).alias("retrained"), "rows"), run_dir, "fits", 0)
        saved(spark, parts, run_dir, 0)
    else:
        path = state.load_state(spark, run_dir, at)[1]["models"].first()["path"]
        if path != parts.models_path:
            models_, weights = state.load_models(spark, path)
            parts = replace(parts, models=models_, weights=weights, models_path=path, vocabulary=state.load_vocabulary(spark, path))
    history = state.read_appended(spark, run_dir, "history", HISTORY, at)
    stopped = _stop_reason(history, at, options)
    while stopped is None:
        at += 1
        sums = history.agg(F.coalesce(F.sum("validated_samples"), F.lit(0)).alias("done"), F.count_if(F.col("predictions_made") == 0).alias("empty")).first()
        phase = "all_predicted" if sums["empty"] else "informative"
        values, parts = run_iteration(spark, parts, table, size, run_dir, at, phase, encoder, judge, options, model, sums["done"])
        names = [f.split()[0] for f in HISTORY.split(", ")]
        row = spark.createDataFrame([tuple(values[n] for n in names)], HISTORY)
        state.append_rows(row, run_dir, "history", at)
        saved(spark, parts, run_dir, at)
        history = state.read_appended(spark, run_dir, "history", HISTORY, at)
        stopped = _stop_reason(history, at, options)
    parts = final_retrain(spark, parts, run_dir, at, options)
    fits = state.read_appended(spark, run_dir, "fits", FITS, at)
    return Outcome(
        run_dir,
        history,
        state.read_appended(spark, run_dir, "validated", VALIDATED, at),
        state.read_appended(spark, run_dir, "log", LOG, at),
        fits,
        progress.performance_stats(history),
        stopped,
        parts.trained,
    )


def final_retrain(spark, parts: Components, run_dir: str, at: int, options: Options) -> Components:
    """Refit every subset at the end and store, in one place under ``run_dir/final``, the models, the whole
    training table, all verdicts and the fits."""
    labelled, rows = labelled_rows(spark, parts, run_dir, at)
    chosen = sorted(r["subset_id"] for r in rows.select("subset_id").distinct().collect())
    final = f"{run_dir}/final"
    parts = refitted(spark, parts, labelled, chosen, options, f"{final}/models/iteration={at}-{uuid.uuid4().hex}")
    verdicts = judging.verdict_cache(f"{run_dir}/verdicts", options.keep_examples)._replace(before=at + 1).stored(spark).drop("bucket")
    state.save_state(
        final,
        at,
        training=labelled,
        verdicts=verdicts,
        fits=fit_rows(rows, parts),
        mapping=parts.mapping,
        models=spark.createDataFrame([(parts.models_path,)], "path string"),
    )
    return parts


def load_final(spark, run_dir: str):
    """Tables of the finished loop and its models, as ``load_models`` gives them."""
    _, tables = state.load_state(spark, f"{run_dir}/final")
    return tables, state.load_models(spark, tables["models"].first()["path"])


def _stop_reason(history: DataFrame, at: int, options: Options) -> str | None:
    """Why the loop ends after iteration ``at``, if it does."""
    if at == 0:
        return None
    flags = progress.stop_points(
        progress.converged(history, min_gain=options.min_information_gain),
        mode=options.stop_mode,
        all_predicted=options.all_predicted_iterations,
    )
    now = flags.where(F.col("iteration") == at).first()
    if now["batch_size"] == 0:
        return "pool exhausted"
    if now["stops"]:
        return options.stop_mode
    if now["empty_count"] == 0 and now["converged"]:
        return "converged"
    return "out of iterations" if options.max_iterations is not None and at >= options.max_iterations else None
