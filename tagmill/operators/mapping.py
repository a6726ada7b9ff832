"""Labels, subsets and the rows that belong to them.

A mapping is a table of ``subset_id, pos, label``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.constants import NOISE_LABEL
from tagmill.functions.text import text_key
from tagmill.operators.sampling import draw_key, take_lowest
from tagmill.storage import lookup_join, pair_with, repeat_rows, settle, split_join


def numbered(labels: DataFrame) -> DataFrame:
    """Number distinct labels from 0 in sorted order as ``_rank``, without bringing them into one task.

    Ranges of labels are written with their partition; each is numbered on its own and the counts of the ranges before are added.
    """
    ranges = labels.repartitionByRange("label").withColumn("_part", F.spark_partition_id())
    ranges = settle(ranges, "labels")
    counts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("label")) - 1
    ranked = ranges.withColumn("_rank", within).join(before, "_part")
    return ranked.select("label", (F.col("_rank") + F.col("_before")).alias("_rank"))


def fixed_mapping(labels: DataFrame, subset_size: int) -> DataFrame:
    """Labels in sorted order, cut into subsets of equal size."""
    ranked = numbered(labels.select("label").distinct())
    return ranked.select(
        F.concat(F.lit("subset_"), F.floor(F.col("_rank") / subset_size).cast("string")).alias("subset_id"),
        F.pmod(F.col("_rank"), F.lit(subset_size)).alias("pos"),
        "label",
    )


def nested_mapping(mapping: DataFrame) -> DataFrame:
    """One row per subset with its labels in order; a subset is small by design."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])
    return mapping.groupBy("subset_id").agg(ordered.alias("labels"))


def flat_mapping(nested: DataFrame) -> DataFrame:
    return nested.select("subset_id", F.posexplode("labels").alias("pos", "label"))


def classes_of(mapping: DataFrame) -> DataFrame:
    """Class numbers per subset: its labels by position, then the noise class."""
    noise = mapping.groupBy("subset_id").agg(F.count(F.lit(1)).cast("int").alias("class_idx"))
    return mapping.select("subset_id", F.col("pos").cast("int").alias("class_idx"), "label").unionByName(
        noise.select("subset_id", "class_idx", F.lit(NOISE_LABEL).alias("label"))
    )


def to_index(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach ``class_idx`` to rows of ``subset_id, label``."""
    return lookup_join(rows, classes_of(mapping), ["subset_id", "label"])


def to_label(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach ``label`` to rows of ``subset_id, class_idx``."""
    return lookup_join(rows, classes_of(mapping), ["subset_id", "class_idx"])


def attach_subset(rows: DataFrame, mapping: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the subset of their label."""
    return lookup_join(rows, mapping.select("label", "subset_id"), "label", how)


def subset_rows(seed: DataFrame, validated: DataFrame, mapping: DataFrame) -> DataFrame:
    """Seed and validated rows of every subset."""
    return attach_subset(seed.unionByName(validated, allowMissingColumns=True), mapping)


def membership(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of ``subset_id, label`` whose label the subset knows, noise rows included."""
    return lookup_join(rows, classes_of(mapping).select("subset_id", "label"), ["subset_id", "label"], "left_semi")


def noise_candidates(rows: DataFrame, mapping: DataFrame, max_rows: int = 1000, seed: int = 42) -> DataFrame:
    """Up to ``max_rows`` rows per subset whose label lies outside it, in draw order.

    At most ``max_rows`` rows of one home subset can be needed, and of the rows so
    kept the first ``2 * max_rows`` contain ``max_rows`` outsiders for every subset.
    Only those meet the subset ids, so the work after sampling does not grow with
    the data. Unmapped labels count as one more home.
    """
    homes = attach_subset(rows, mapping, "left").withColumn("_home", F.coalesce("subset_id", F.lit("")))
    homes = homes.drop("subset_id")
    nearest = take_lowest(homes, ["_home"], ["row_id"], max_rows, seed)
    first = settle(nearest.orderBy(draw_key(seed, "row_id"), "row_id").limit(2 * max_rows), "noise")
    grid = pair_with(first, mapping.select("subset_id").distinct(), "subset_id")
    order = Window.partitionBy("subset_id").orderBy(draw_key(seed, "row_id"), "row_id")
    return (
        grid.where(F.col("_home") != F.col("subset_id"))
        .drop("_home")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= max_rows)
    )


def class_averages(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows per class and subset, over present labels and over all its labels."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_join(mapping.select("subset_id", "label"), counts, "label", "left")
    return joined.groupBy("subset_id").agg(
        F.avg("n").alias("avg_present"), F.avg(F.coalesce("n", F.lit(0))).alias("avg_all")
    )


def noise_targets(rows: DataFrame, mapping: DataFrame, factor: float = 2.0) -> DataFrame:
    """Number of noise rows each subset wants."""
    target = F.floor(F.coalesce("avg_present", F.lit(1.0)) * factor)
    return class_averages(rows, mapping).select("subset_id", target.cast("long").alias("target"))


def oversample_noise(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Noise rows per subset: the first ``target`` candidates, or all of them in
    turn until the target is reached.

    A candidate at place ``p`` of ``m`` appears ``target // m`` times and once more
    when ``p <= target % m``; nothing is ranked after repeating.
    """
    sizes = candidates.groupBy("subset_id").agg(F.count(F.lit(1)).alias("_m"))
    joined = lookup_join(candidates, lookup_join(targets, sizes, "subset_id"), "subset_id")
    copies = F.floor(F.col("target") / F.col("_m")) + F.when(
        F.col("place") <= F.pmod(F.col("target"), F.col("_m")), 1
    ).otherwise(0)
    counted = joined.withColumn("_copies", copies).drop("_m", "target", "place")
    return repeat_rows(counted, "_copies", ["subset_id", "row_id"], "copy")


def training_with_noise(
    labelled: DataFrame, mapping: DataFrame, factor: float = 2.0, max_rows: int = 1000, seed: int = 42
) -> DataFrame:
    """Training rows of every subset with its noise rows labelled as noise."""
    own = attach_subset(labelled, mapping).withColumn("copy", F.lit(0).cast("long"))
    candidates = noise_candidates(labelled, mapping, max_rows, seed)
    noise = oversample_noise(candidates, noise_targets(labelled, mapping, factor))
    return own.unionByName(noise.withColumn("label", F.lit(NOISE_LABEL)))


def label_by_text(queries: DataFrame, labelled: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Label of the first labelled row with the same text; ``src`` orders the sources."""
    first = labelled.groupBy(text_key(F.col("text")).alias("text_md5"), "text").agg(
        F.min_by("label", F.struct("src", "row_id")).alias("label")
    )
    keyed = queries.withColumn("text_md5", text_key(F.col("text")))
    return split_join(keyed, first, ["text_md5", "text"], "left", hot_rows)


def label_by_vector(queries: DataFrame, label_vectors: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Label whose vector equals the given one; the first in label order."""
    first = label_vectors.groupBy("vector").agg(F.min("label").alias("label"))
    return split_join(queries, first, "vector", "left", hot_rows)


def holdout(rows: DataFrame, chosen: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows not chosen for training."""
    return rows.join(chosen.select(row_id), row_id, "left_anti")


def union_labelled(seed: DataFrame, validated: DataFrame) -> DataFrame:
    """Bag union with the source of each row; duplicates stay."""
    return seed.withColumn("src", F.lit("seed")).unionByName(validated.withColumn("src", F.lit("validated")))
