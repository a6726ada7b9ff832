"""Deterministic sampling, splitting and numbering.

Rows are drawn in the order of ``md5(seed:id)``, which does not depend on
partitioning. A draw never sorts a whole group: counts per hash prefix locate the
prefix in which the quota ends, and the prefix grows until it holds few rows. Only
those are ranked, and the cut found there is compared with every row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.constants import EXPERIMENT_SIZES
from tagmill.storage import as_lookup, lookup_join, settle

# Most rows of a group that are ranked in one task.
RANKED_ROWS = 10_000


def draw_key(seed: int, *ids: str) -> Column:
    """Pseudo-random sort key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def mark_lowest(rows: DataFrame, by, ids, quota, seed: int = 42, digits: int = 3, flag: str = "picked") -> DataFrame:
    """Flag the ``quota`` rows per group that come first in draw order.

    ``quota`` is a number, a function of the group's row count column, or a
    DataFrame with the group columns and ``quota``. ``ids`` identify a row within
    its group.
    """
    by, ids = list(by), list(ids)
    keyed = rows.withColumn("_draw", draw_key(seed, *ids))
    group = by or ["_all"]
    if not by:
        keyed = keyed.withColumn("_all", F.lit(0))
    narrow = settle(keyed.select(*group, *ids, "_draw"), "draws")
    groups = _ends(narrow, group, quota, digits)
    ranked = (
        lookup_join(narrow, groups, group)
        .where(~F.col("_everything") & F.col("_draw").startswith(F.col("_prefix")))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_draw", *ids)))
    )
    last = ranked.where("_rank = _need").select(*group, F.struct("_draw", *ids).alias("_cut"))
    cuts = as_lookup(groups.table.select(*group, "_everything").join(last, group, "left"), "cut")
    here = F.struct("_draw", *ids)
    marked = lookup_join(keyed, cuts, group).withColumn(
        flag, F.col("_everything") | F.coalesce(here <= F.col("_cut"), F.lit(False))
    )
    return marked.select(*rows.columns, flag)


def _ends(narrow: DataFrame, group, quota, digits: int):
    """Per group whether its quota covers it, else the prefix in which the quota ends and how many
    rows it wants there."""
    sizes = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    if isinstance(quota, DataFrame):
        sizes = lookup_join(sizes, quota.select(*group, F.col("quota").alias("_need")), group, "left")
        sizes = sizes.withColumn("_need", F.coalesce("_need", F.lit(0)))
    else:
        sizes = sizes.withColumn("_need", quota(F.col("_size")) if callable(quota) else F.lit(quota))
    sizes = sizes.withColumn("_need", F.col("_need").cast("long"))
    found = settle(sizes.withColumn("_everything", F.col("_need") >= F.col("_size")).withColumn("_prefix", F.lit("")), "quota")
    length = 0
    while length < 32 and not found.where((F.col("_size") > RANKED_ROWS) & ~F.col("_everything") & (F.col("_need") > 0)).isEmpty():
        length = min(length + digits, 32)
        large = (F.col("_size") > RANKED_ROWS) & ~F.col("_everything") & (F.col("_need") > 0)
        inside = lookup_join(narrow, found.where(large).select(*group, "_prefix", "_need"), group)
        inside = inside.where(F.col("_draw").startswith(F.col("_prefix")))
        counts = inside.groupBy(*group, "_need", F.substring("_draw", 1, length).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")))
        ends = upto.where((F.col("_need") > F.col("_upto") - F.col("_n")) & (F.col("_need") <= F.col("_upto")))
        here = ends.select(*group, F.col("_n").alias("_size"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"),
                           F.lit(False).alias("_everything"), F.col("_bucket").alias("_prefix"))
        found = settle(found.where(~large).unionByName(here), "quota")
    return as_lookup(found)


def take_lowest(rows, by, ids, quota, seed: int = 42, digits: int = 3) -> DataFrame:
    """The first ``quota`` rows per group in draw order."""
    return mark_lowest(rows, by, ids, quota, seed, digits).where("picked").drop("picked")


def sample_rows(rows: DataFrame, n: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """``n`` rows of the whole table."""
    return take_lowest(rows, [], [row_id], n, seed)


def sample_examples(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per label with their place in the draw."""
    drawn = take_lowest(rows, ["label"], ["row_id"], n, seed)
    order = Window.partitionBy("label").orderBy(draw_key(seed, "row_id"), "row_id")
    return drawn.withColumn("place", F.row_number().over(order))


def large_classes(rows: DataFrame, least: int, largest: int) -> DataFrame:
    """Labels with at least ``least`` rows; without any, the ``largest`` largest classes.

    ``rule`` says which of the two applied (``enough`` or ``largest``).
    """
    counts = settle(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "classes")
    return _large(counts, least, largest)


def _large(counts: DataFrame, least: int, largest: int) -> DataFrame:
    enough = counts.where(F.col("n") >= least)
    if enough.isEmpty():
        return counts.orderBy(F.desc("n"), "label").limit(largest).withColumn("rule", F.lit("largest"))
    return enough.withColumn("rule", F.lit("enough"))


def train_pool_split(rows: DataFrame, per_class: int, largest: int, seed: int = 42) -> DataFrame:
    """Flag ``per_class`` training rows of each large class; the rest is the pool.

    See ``large_classes`` for ``largest``; rows of other classes are left out, as the experiment wants it.
    """
    kept = lookup_join(rows, large_classes(rows, per_class, largest).select("label"), "label", "left_semi")
    return mark_lowest(kept, ["label"], ["row_id"], per_class, seed, flag="is_train")


def fraction_split(rows: DataFrame, by, ids, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Flag the training share of each class; a class of one row trains."""
    percent = 100 - round(100 * validation)

    def share(total):
        return F.when(total < 2, total).otherwise(F.floor((total * percent + 50) / 100))

    return mark_lowest(rows, by, ids, share, seed, flag="is_train")


def experiment_splits(rows: DataFrame, largest_classes: int, sizes=EXPERIMENT_SIZES, seed: int = 42) -> DataFrame:
    """The split of ``train_pool_split`` for several sizes at once.

    Each row is ranked only up to the largest size, then repeated per size in which
    its class takes part.
    """
    largest = max(sizes)
    counts = settle(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "classes")
    chosen = None
    for size in sizes:
        part = _large(counts, size, largest_classes).select("label", F.lit(size).alias("per_class"))
        chosen = part if chosen is None else chosen.unionByName(part)
    per_label = chosen.groupBy("label").agg(F.collect_list("per_class").alias("sizes"))
    marked = mark_lowest(rows, ["label"], ["row_id"], largest, seed, flag="_near")
    order = Window.partitionBy("label").orderBy(draw_key(seed, "row_id"), "row_id")
    near = marked.where("_near").withColumn("_rank", F.row_number().over(order))
    far = marked.where("NOT _near").withColumn("_rank", F.lit(largest + 1))
    return (
        lookup_join(near.unionByName(far).drop("_near"), per_label, "label")
        .withColumn("per_class", F.explode("sizes"))
        .withColumn("role", F.when(F.col("_rank") <= F.col("per_class"), "train").otherwise("pool"))
        .drop("sizes", "_rank")
    )


def number_rows(rows: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Give each row its 0-based place in the order of a unique column.

    The table is range-partitioned and written once; a row's place is the count in
    earlier partitions plus its rank in its own.
    """
    parts = settle(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbered = parts.withColumn("_rank", rank)
    return lookup_join(numbered, offsets, "_part").withColumn(name, F.col("_offset") + F.col("_rank") - 1).select(
        *rows.columns, name
    )


def batch_slice(rows: DataFrame, batch_size: int, batch: int, position: str = "position") -> DataFrame:
    """Rows of one batch, by position."""
    start = batch * batch_size
    return rows.where((F.col(position) >= start) & (F.col(position) < start + batch_size))
