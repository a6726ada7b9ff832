"""Mix sources to target weights by entropy balancing.

Every word of a document starts with rate 1. The rates that meet the token constraints at the
least relative entropy are exponential tilts ``exp(multiplier of the source)``; the multipliers solve
the convex dual ``sum(size * exp(m)) - m * target`` by Newton steps. A document enters the dual
through its source and size alone, so one distributed aggregation gives gradient and Hessian of all
sources (the Hessian is diagonal) and the steps run per source, as rows of a table.

Rates become copies by systematic rounding: everybody gets the whole part of the rate, and one
copy more goes to documents in the order of the hash of their id until the words still
wanted are reached. The hash at which that happens is found from histograms over hash ranges, and only the range
in which it lies is ranked; each row is then compared with it. So no source is ever sorted or
gathered, however large, and reruns agree.

Defined cases: a null or empty text has size 0; null is a source, after all others; a source without
words has target 0; repeated rows (same id and source) share one decision; an empty table gives an
empty result; an input column named like a result is replaced.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import WORD, group_key, packed, unpacked
from tagmill.storage import lookup_join, settle

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
NEWTON_STEPS = 60
RANKED_ROWS = 4096
HASH_BITS = 60


def sized(docs: DataFrame, text="text", source="source", ident="doc_id") -> DataFrame:
    """``doc`` with its size, its source's key and its place in the order of copies."""
    row = lambda name: F.col("doc").getField(name)
    order = F.conv(F.substring(F.md5(F.coalesce(row(ident).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10)
    return packed(docs).select(
        "doc",
        F.coalesce(F.regexp_count(row(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        row(source).cast("string").alias("source_value"),
        group_key(row(source)).alias("g"),
        order.cast("bigint").alias("h"),
    )


def numbered(sources: DataFrame) -> DataFrame:
    """Number sources from 0 by code point, null last, without bringing them into one task.

    Ranges of sources are written with their partition; each is numbered on its own and the
    counts of the ranges before are added.
    """
    ranges = sources.repartitionByRange(F.col("source_value").asc_nulls_last())
    ranges = settle(ranges.withColumn("part", F.spark_partition_id()), "sources")
    within = Window.partitionBy("part").orderBy(F.col("source_value").asc_nulls_last())
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranges.withColumn("place", F.row_number().over(within) - 1)
    return ranked.join(before, "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def with_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE_PERCENT, cap=CAP) -> DataFrame:
    """Add ``target``: weight shares of all words, stopped at ``cap`` times a source's words.

    The excess goes to the others by weight until none is above. Each round needs two sums over the
    sources; the driver holds these two numbers only.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = settle(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap), "weights")
    unit, stopped = None, -1
    while True:
        open_ = F.lit(True) if unit is None else F.col("weight") * unit <= F.col("most")
        totals = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(open_, F.col("weight"))).alias("weight"),
            F.sum(F.when(~open_, F.col("most"))).alias("stopped"),
            F.count_if(~open_).alias("n"),
        ).first()
        if totals["weight"] is None or totals["n"] == stopped:
            break
        stopped = totals["n"]
        unit = (totals["all"] * share / 100 - (totals["stopped"] or 0)) / totals["weight"]
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(unit or 0))))


def with_rates(sources: DataFrame) -> DataFrame:
    """Add ``rate``: the exponential tilt at which a source's words meet its target."""
    words, target = F.col("source_size").cast("double"), F.col("target")

    def newton(m, _):
        gradient = words * F.exp(m) - target
        return m - gradient / (words * F.exp(m))

    steps = F.sequence(F.lit(1), F.lit(NEWTON_STEPS))
    solved = F.exp(F.aggregate(steps, F.lit(0.0), newton))
    return sources.withColumn("rate", F.when((words > 0) & (target > 0), solved).otherwise(F.lit(0.0)))


def with_cuts(sources: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``whole`` copies and ``cut``: documents with a hash up to it get one copy more."""
    # The tilt meets the target up to the last bits; snap to a whole number of copies there.
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-9
    rows = sources.withColumn("whole", F.when(near, F.round("rate")).otherwise(F.floor("rate")).cast("bigint"))
    rows = rows.withColumn("wanted", F.when(near, F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size")))
    rows = rows.withColumn("bits", F.ceil(F.log2(F.greatest(F.col("rows") / RANKED_ROWS, F.lit(1.0)))).cast("int"))
    rows = settle(rows, "rates")
    open_ = rows.where("wanted > 0").select("g", "wanted", "bits")
    ranged = lookup_join(sizes, open_, "g").withColumn("range", F.call_function("shiftright", F.col("h"), F.lit(HASH_BITS) - F.col("bits")))
    sums = ranged.groupBy("g", "wanted", "range").agg(F.sum("size").alias("size"))
    upto = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("g").orderBy("range")))
    edge = upto.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("size") < F.col("wanted")))
    edge = edge.select("g", "range", (F.col("upto") - F.col("size")).alias("before"))
    inside = lookup_join(ranged, edge, ["g", "range"])
    by_hash = inside.groupBy("g", "wanted", "before", "h").agg(F.sum("size").alias("size"))
    running = by_hash.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("g").orderBy("h")))
    # The document at the edge is taken if more than half of it is wanted.
    taken = running.where(F.col("upto") - F.col("size") / 2 <= F.col("wanted"))
    cuts = taken.groupBy("g").agg(F.max("h").alias("last"))
    first = edge.select("g", F.col("range").alias("edge"))
    out = rows.join(first, "g", "left").join(cuts, "g", "left")
    start = F.call_function("shiftleft", F.col("edge"), F.lit(HASH_BITS) - F.col("bits")) - 1
    return out.withColumn("cut", F.coalesce("last", start, F.lit(-1)))


def mixed(docs: DataFrame, text="text", source="source", ident="doc_id", weights=WEIGHTS, share=SHARE_PERCENT, cap=CAP) -> DataFrame:
    """All input columns with ``size, source_size, target, rate, copies`` and ``taken`` (words the mix takes)."""
    rows = sized(docs, text, source, ident)
    sizes = settle(rows.select("source_value", "g", "h", "size"), "sizes")
    sources = sizes.groupBy("g", "source_value").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    planned = with_cuts(with_rates(with_targets(numbered(sources), weights, share, cap)), sizes)
    plan = settle(planned.select("g", "source_size", "target", "rate", "whole", "cut"), "plan")
    out = lookup_join(rows.drop("source_value"), plan, "g")
    out = out.withColumn("copies", F.col("whole") + (F.col("h") <= F.col("cut")).cast("bigint"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return unpacked(out, ["size", "source_size", "target", "rate", "copies", "taken"])
