"""Best-fit packing of token sequences, planned over the histogram of lengths.

Documents are encoded and cut into pieces; the driver sees only how many pieces there are of each
length (as many numbers as a sequence has places). Best fit, longest first, runs over these counts: a run
of equal pieces goes into a run of equally full sequences at once. The plan says, per length, which ranks
go to which sequences at which offset. A piece takes its slot by its rank among the pieces of
its length: its place within its partition, counted while encoding, plus the counts of earlier partitions. So pieces are not
shuffled at all, and a length that a third of all pieces has is spread like any other.

Defined cases: a null or empty text is the end token alone; repeated rows are packed once each; a text of
any length is encoded whole; an empty table gives an empty result; only id and text are read, so other
columns cannot clash; a null id is carried along.
"""

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.tokens import BATCH_BYTES, encoder, slices
from tagmill.storage import lookup_join, settle


class Packing(NamedTuple):
    """``cut_bytes``: text that is cut at a time; fewer take less memory and more time."""

    tokenizer: str
    length: int = 1024
    end_id: int = 2
    cut_bytes: int = BATCH_BYTES


def piece_bounds(count: int, length: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``count`` ids: full ones, the first may be shorter."""
    first = count % length
    starts = ([0] if first else []) + list(range(first, count, length))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], count], strict=True)], strict=True))


def pieces(docs: DataFrame, packing: Packing, text="text", ident="doc_id", keep_ids=True) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit), their checksum, and its
    place among the pieces of its length in its partition."""

    def cut(batches):
        coder = encoder(packing.tokenizer, packing.end_id)
        part, places = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for docs_in in slices(batch, 1, packing.cut_bytes):
                flat, edges = coder.ids(docs_in.column(1))
                raw, rows = memoryview(flat.astype("<u4").tobytes()), []
                for row, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    for number, (start, length) in enumerate(piece_bounds(end - begin, packing.length)):
                        at = 4 * (begin + start)
                        rows.append((row, number, start, length, zlib.crc32(raw[at : at + 4 * length]), part, places[length]))
                        places[length] += 1
                owner, number, *others = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                columns = [docs_in.column(0).take(pa.array(owner)), pa.array(number.astype(np.int32)), *map(pa.array, others)]
                if keep_ids:
                    # Pieces follow one another in the ids of the batch.
                    bounds = 4 * np.concatenate(([0], np.cumsum(others[1]))).astype(np.int64)
                    found = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
                    columns.append(found.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        # Later tasks of the worker need not hold what this one has freed.
        pa.default_memory_pool().release_unused()

    names = ["id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * keep_ids
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, place bigint" + ", ids binary" * keep_ids
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, count, first sequence, offset)`` by best fit, longest first."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: runs of sequences
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]

        def place(first, count, offset, length=length):
            nonlocal rank, left
            runs.append((length, rank, count, first, offset))
            rank, left = rank + count, left - count

        while left:
            room = next((r for r in range(length, capacity + 1) if free[r]), None)
            if room is not None:
                first, count = free[room].pop()
                # The sequence just filled is the fullest with room left, so it takes as many as fit.
                each = min(room // length, left)
                used = min(left // each, count)
                if used < count:
                    free[room].append((first + used, count - used))
                free[room - each * length].append((first, used))
                for slot in range(each):
                    place(first, used, capacity - room + slot * length)
                continue
            # Every open sequence is too full: open new ones, each filled with as many as fit.
            each = min(capacity // length, left)
            new = max(left // each, 1)
            for slot in range(each):
                place(opened, new, slot * length)
            free[capacity - each * length].append((opened, new))
            opened += new
    return runs


def planned(found: DataFrame, capacity: int) -> DataFrame:
    """The plan as a table; it has a few runs per length, whatever the number of pieces."""
    counts = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length
    runs = best_fit({row["length"]: row["n"] for row in counts}, capacity)
    return found.sparkSession.createDataFrame(runs, "length bigint, rank_from bigint, n bigint, seq_from bigint, offset bigint")


def pack(docs: DataFrame, packing: Packing, text="text", ident="doc_id", keep_ids=True) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    found = settle(pieces(docs, packing, text, ident, keep_ids), "pieces")
    plan = planned(found, packing.length)
    counts = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.struct("length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n")).alias("x"))
    # One row per partition: pieces in earlier ones, by length.
    before = before.groupBy("part").agg(F.map_from_entries(F.collect_list("x")).alias("before"))
    ranked = lookup_join(found, before, "part", salts=1)
    ranked = ranked.withColumn("rank", F.col("place") + F.element_at("before", F.col("length"))).drop("place", "before", "part")
    slot = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("n"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & slot)
    sequence = F.col("seq_from") + F.col("rank") - F.col("rank_from")
    keep = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return placed.select(F.col("id").alias(ident), *keep, sequence.alias("sequence_id"), "offset")
