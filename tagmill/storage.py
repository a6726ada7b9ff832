"""Shared-folder tables: lineage cuts, counted lookups, size-checked joins."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup within these limits is broadcast; a larger one is joined by salted shuffle.
KNOWN_SMALL_BYTES = 10 * 1024 * 1024
LOOKUP_ROWS = 100_000
LOOKUP_BYTES = 64 * 1024 * 1024
GRID_ROWS = 256
SALTS = 32
CHUNK = 10_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Folders of the ``temporary`` blocks that run, the innermost last.
FOLDERS: ContextVar[tuple] = ContextVar("folders", default=())


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Only a local session without one gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tagmill-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: short lineage, survives lost executors.

    Shuffle files go when the table is written. Within ``temporary`` the table goes with the block.
    """
    folders = FOLDERS.get()
    path = f"{folders[-1]}/{name}-{uuid.uuid4().hex}" if folders else fresh_path(df.sparkSession, name)
    with cleared_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared_shuffles(spark: SparkSession):
    """Within the block the shuffle files of a query go when the query ends, not when the driver next clears its memory.

    A frame must not run twice within the block.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def temporary(spark: SparkSession, name: str):
    """Tables that are settled within the block go at its end; see ``lasting``."""
    folder = fresh_path(spark, name)
    token = FOLDERS.set((*FOLDERS.get(), folder))
    try:
        yield
    finally:
        FOLDERS.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def lasting():
    """Tables that are settled within this block outlive the ``temporary`` block around it."""
    token = FOLDERS.set(FOLDERS.get()[:-1])
    try:
        yield
    finally:
        FOLDERS.reset(token)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Lookup(NamedTuple):
    """A per-label (or per-group) table and whether its size allows a broadcast."""

    table: DataFrame
    small: bool


def as_lookup(df: DataFrame, name: str = "lookup") -> Lookup:
    """Check the size of a lookup.

    It is small if its rows, which are counted, and its bytes are few. A table that Catalyst does not take for
    small is written once first. An estimate alone is not enough: it misses what rows multiply to.
    """
    if estimated_bytes(df) <= KNOWN_SMALL_BYTES and df.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return Lookup(df, True)
    table = settle(df, name)
    return Lookup(table, estimated_bytes(table) <= LOOKUP_BYTES and table.count() <= LOOKUP_ROWS)


def lookup_join(rows, lookup, on, how="inner", salts=SALTS) -> DataFrame:
    """Join a large table to a lookup.

    A lookup of checked size is broadcast and ``rows`` is not shuffled. Beyond that
    every lookup row is repeated per salt and the rows of a hot key spread over
    ``salts`` tasks. Both ways give the same result. The repeated rows are merged, never broadcast: Catalyst takes them
    for as few as the rows of the lookup.
    """
    if not isinstance(lookup, Lookup):
        lookup = as_lookup(lookup)
    on = [on] if isinstance(on, str) else list(on)
    if lookup.small:
        return rows.join(F.broadcast(lookup.table), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    return salted.join(lookup.table.withColumn("_salt", F.explode(every)).hint("merge"), [*on, "_salt"], how).drop("_salt")


def split_join(rows, matches, on, how="left", hot_rows=1_000_000) -> DataFrame:
    """Join ``rows`` to ``matches`` (unique per key) when a key may be very frequent.

    At most ``count / hot_rows`` keys are hot; their matches form a lookup, the
    remaining rows take a plain shuffle join.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot_keys = settle(rows.groupBy(*on).count().where(F.col("count") >= hot_rows).select(*on), "hot")
    if hot_keys.isEmpty():
        return rows.join(matches, on, how)
    hot = as_lookup(hot_keys)
    hot_matches = lookup_join(matches, hot, on, "left_semi")
    in_hot = lookup_join(rows, hot, on, "left_semi")
    others = lookup_join(rows, hot, on, "left_anti")
    return lookup_join(in_hot, hot_matches, on, how).unionByName(others.join(matches, on, how))


def only_needed(table: DataFrame, rows: DataFrame, on) -> DataFrame:
    """Rows of a large keyed table whose key occurs in ``rows``.

    The keys of a small batch are broadcast, so a grown cache is scanned but not
    shuffled; many keys take a plain shuffle join.
    """
    on = [on] if isinstance(on, str) else list(on)
    keys = as_lookup(rows.select(*on).distinct(), "keys")
    return table.join(F.broadcast(keys.table) if keys.small else keys.table, on, "left_semi")


def pair_with(rows: DataFrame, items: DataFrame, order: str) -> DataFrame:
    """Every row with every row of ``items``, in blocks.

    Only for results that are that grid themselves (sampled rows by subsets). The items are dealt to blocks
    by the hash of ``order``, and every row meets every block.
    """
    table = settle(items, "items")
    blocks = -(-table.count() // GRID_ROWS)
    dealt = table.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(max(blocks, 1))))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")) if blocks else F.array().cast("array<long>")
    return lookup_join(rows.withColumn("_block", F.explode(every)), dealt, "_block").drop("_block")


def repeat_rows(rows: DataFrame, copies: str, ids, name: str) -> DataFrame:
    """Repeat each row ``copies`` times, numbered from 1.

    A row is first cut into chunks of copies, which spread over tasks before the
    copies are made.
    """
    chunks = rows.where(F.col(copies) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / CHUNK)))
    )
    first = F.col("_chunk") * CHUNK + 1
    last = F.least(F.col(copies).cast("long"), first + (CHUNK - 1))
    return (
        chunks.repartition(*ids, "_chunk").withColumn(name, F.explode(F.sequence(first, last))).drop("_chunk", copies)
    )


def spread(scan: DataFrame) -> DataFrame:
    """Give a small scan one partition per core before heavy per-row work.

    Only for frames without a shuffle. A table of many files already has more
    partitions than cores and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
