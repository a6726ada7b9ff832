"""Label vectors and the split of the label space into dissimilar subsets."""

from functools import reduce

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.functions.vectors import doubles, dot, norm
from tagmill.operators.neighbours import knn_join, similar_pairs
from tagmill.storage import as_lookup, lookup_join, settle

# Vectors of a taxonomy that one task may hold.
TASK_BYTES = 32 * 1024 * 1024


def centroids(rows: DataFrame, *by: str) -> DataFrame:
    """Mean vector per group, pre-aggregated in every task."""
    mean = Summarizer.mean(array_to_vector(doubles(F.col("vector"))))
    return rows.groupBy(*by).agg(vector_to_array(mean).alias("vector"))


def reduce_dims(vectors: DataFrame, dims: int) -> DataFrame:
    """Replace ``vector`` by its first ``dims`` principal components."""
    table = settle(vectors, "vectors")
    wide = table.withColumn("_wide", array_to_vector(doubles(F.col("vector"))))
    model = PCA(k=dims, inputCol="_wide", outputCol="_narrow").fit(wide)
    return model.transform(wide).withColumn("vector", vector_to_array("_narrow")).drop("_wide", "_narrow")


def label_similarity(label_vectors: DataFrame, digits: int = 9) -> DataFrame:
    """Cosine of every two labels, each pair once; blocks of labels are multiplied."""
    left = label_vectors.select(F.col("label").alias("query_id"), "vector")
    right = label_vectors.select(F.col("label").alias("item_id"), "vector")
    pairs = similar_pairs(left, right, digits=digits).where(F.col("query_id") < F.col("item_id"))
    return pairs.select(F.col("query_id").alias("label"), F.col("item_id").alias("other"), "similarity")


def least_similar(label_vectors: DataFrame, digits: int = 9) -> DataFrame:
    """For each label (``target``) the other label least similar to it; the first label on ties.

    It is the nearest neighbour of the opposite vector, so every block of labels gives one candidate only.
    """
    opposite = F.transform(doubles(F.col("vector")), lambda x: -x)
    left = label_vectors.select(F.col("label").alias("query_id"), opposite.alias("vector"))
    right = label_vectors.select(F.col("label").alias("item_id"), "vector")
    found = knn_join(left, right, 1, skip_same=True, digits=digits)
    return found.select(F.col("query_id").alias("target"), F.col("item_id").alias("label"), (-F.col("similarity")).alias("similarity"))


def greedy_subsets(label_vectors: DataFrame, subset_size: int = 8, taxonomy=(), task_bytes: int = TASK_BYTES) -> DataFrame:
    """Split labels into subsets of mutually dissimilar labels.

    Each subset starts with the first free label in sorted order and takes the free
    label least similar to its mean until it is full. Taxonomies whose vectors take at most ``task_bytes`` are split
    whole inside tasks, all of them in one job; larger ones pick by pick over distributed vectors.
    """
    by = list(taxonomy)
    group = by or ["_all"]
    if not by:
        label_vectors = label_vectors.withColumn("_all", F.lit(0))
    labels = settle(label_vectors.select(*group, "label", doubles(F.col("vector")).alias("vector")), "labels")
    large = settle(labels.groupBy(*group).agg(F.sum(8 * F.size("vector") + 64).alias("_bytes")).where(F.col("_bytes") > task_bytes).select(*group), "large")
    if large.isEmpty():
        every = picked_in_tasks(labels, group, subset_size)
    else:
        wide = as_lookup(large)
        every = picked_in_tasks(lookup_join(labels, wide, group, "left_anti"), group, subset_size)
        every = every.unionByName(picked_one_by_one(settle(lookup_join(labels, wide, group, "left_semi"), "labels"), group, subset_size))
    out = every.select(
        *group,
        F.concat(F.lit("subset_"), F.floor(F.col("_step") / subset_size).cast("string")).alias("subset_id"),
        (F.col("_step") % subset_size).alias("pos"),
        "label",
    )
    return out if by else out.drop("_all")


def picked_in_tasks(labels: DataFrame, group, subset_size: int) -> DataFrame:
    """``label, _step`` of every taxonomy, each split inside one task."""
    schema = labels.select(*group, "label").schema.add("_step", "long")

    def split(found):
        import numpy as np

        found = found.sort_values("label", ignore_index=True)
        vectors = np.array(found["vector"].to_list(), dtype=np.float64).reshape(len(found), -1)
        size = np.sqrt((vectors * vectors).sum(axis=1))
        free, order, total = np.ones(len(found), bool), [], None
        for step in range(len(found)):
            at = np.flatnonzero(free)
            if step % subset_size == 0:
                pick, total = at[0], np.zeros(vectors.shape[1])
            else:
                # Sums along a row come out alike for equal rows, so that ties fall to the first label.
                near = (vectors[at] * total).sum(axis=1)
                near = np.where(size[at] > 0, near / np.where(size[at] > 0, size[at], 1.0), 0.0)
                pick = at[near.argmin()]
            free[pick] = False
            total = total + vectors[pick]
            order.append(pick)
        out = found.iloc[order][[*group, "label"]].copy()
        out["_step"] = np.arange(len(order))
        return out

    return labels.groupBy(*group).applyInPandas(split, schema)


def picked_one_by_one(labels: DataFrame, group, subset_size: int) -> DataFrame:
    """``label, _step`` for taxonomies of any size.

    A pick depends on the ones before, so there is one aggregation per pick, for all taxonomies at once. The driver holds, per
    taxonomy, the sum of the open subset's vectors; picked labels go to a table of their own.
    """
    spark = labels.sparkSession
    free = labels.withColumn("_size", norm(F.col("vector"))).persist()
    steps = labels.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    picked_schema = labels.select(*group, "label").schema.add("_step", "long")
    sums, picks, tables = {}, [], []
    for step in range(steps):
        first = step % subset_size == 0
        if picks:
            taken = F.broadcast(spark.createDataFrame([p[:-1] for p in picks], labels.select(*group, "label").schema))
            open_ = free.join(taken, [*group, "label"], "left_anti")
        else:
            open_ = free
        if first:
            order = F.struct("label")
            found = open_.groupBy(*group).agg(F.min_by(F.struct("label", "vector"), order).alias("pick")).collect()
            sums = {}
        else:
            totals = F.broadcast(spark.createDataFrame([(*k, v) for k, v in sums.items()], labels.select(*group, F.col("vector").alias("_sum")).schema))
            near = F.when(F.col("_size") > 0, dot(F.col("vector"), F.col("_sum")) / F.col("_size")).otherwise(F.lit(0.0))
            scored = open_.join(totals, group).withColumn("_near", near)
            found = scored.groupBy(*group).agg(F.min_by(F.struct("label", "vector"), F.struct("_near", "label")).alias("pick")).collect()
        for row in found:
            k = tuple(row[g] for g in group)
            vector = list(row["pick"]["vector"])
            sums[k] = [a + b for a, b in zip(sums[k], vector)] if k in sums else vector
            picks.append((*k, row["pick"]["label"], step))
        if (step + 1) % subset_size == 0 or step + 1 == steps:
            # A full subset leaves the free labels for good.
            done = settle(spark.createDataFrame(picks, picked_schema), "picked")
            tables.append(done)
            rest = settle(free.join(F.broadcast(done.select(*group, "label")), [*group, "label"], "left_anti"), "free")
            free.unpersist()
            free, picks = rest.persist(), []
    free.unpersist()
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], picked_schema)
