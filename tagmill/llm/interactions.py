"""What a filter removes depends on the filters before it: every order of them, and Shapley values.

Which of the filters a document fails is a set, so documents are counted by that set (and by their labels) per part. The states a
row of filters passes through are subsets of the filters; an edge of that lattice adds one filter to a state and removes
the documents that fail it and none of the state. Path counts in both directions, from the empty state
and from the full one, say how many orders run over an edge; a filter's Shapley sum weighs its edges by these counts.
The steps of any single order read the same edges.

A text identical to one of a smaller id fails ``E``. Texts are told apart by SHA-256. The least id of each text is found
with partial sums and joined back on text and id, so a text that a third of all rows share meets nothing but its
own first row.

Defined cases: a null text counts as empty; a null id is neither smaller nor larger than others, so it fails no ``E`` and has no
labels; rows repeated under one id are documents of their own and equally smaller or larger than others;
a null part counts as the empty string; a document with several label rows has a label if any row gives it; an empty table
gives an empty result; texts of any length are read whole, in blocks; the columns read are named by arguments, so
others cannot clash.
"""

import re
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.storage import settle, split_join

FILTERS = "ABCDE"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
UPPER = bytes(range(0x41, 0x5B))
CONTINUATION = bytes(range(0x80, 0xC0))
MARKS = b"#$%&*|"
BLOCK = 1 << 22


class Limits(NamedTuple):
    """Failure conditions of the filters A to C."""

    min_words: int = 100
    min_distinct_percent: int = 80
    max_upper_percent: int = 10


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words and different words of one UTF-8 text."""
    if len(raw) <= BLOCK:
        words = raw.split()  # bytes split at ASCII white space only
        return len(words), len(set(words))
    count, seen, at = 0, set(), 0
    while at < len(raw):
        cut = BLANK.search(raw, at + BLOCK)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        count, at = count + len(words), end
        seen.update(words)
    return count, len(seen)


def text_failures(raw: bytes, limits: Limits) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = word_counts(raw)
    upper = len(raw) - len(raw.translate(None, UPPER))
    points = len(raw.translate(None, CONTINUATION))
    fails = (
        words < limits.min_words,
        100 * distinct < limits.min_distinct_percent * words,
        100 * upper > limits.max_upper_percent * points,
        len(raw) > len(raw.translate(None, MARKS)),
    )
    return sum(1 << bit for bit, failed in enumerate(fails) if failed)


def failure_counts(docs: DataFrame, labels: DataFrame, part="lang", text="text", ident="doc_id", limits: Limits = Limits()) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the filters they fail and their labels."""

    @F.arrow_udf("int")
    def failed(raw: pa.Array) -> pa.Array:
        return pa.array([text_failures(value.as_py(), limits) for value in raw], pa.int32())

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(ident).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), failed(whole.cast("binary")).alias("mask"),
    )
    rows = settle(rows, "failures")
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    alike = rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    rows = alike.join(firsts, ["id", "digest"], "left")
    rows = rows.select("id", "part", F.col("mask").bitwiseOR(F.when(again, 16).otherwise(0)).alias("mask"), "n")
    given = labels.select(F.col(ident).alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id")
    has = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    given = given.agg(has("quality"), has("toxic"))
    rows = split_join(settle(rows, "failures"), given, "id")
    rows = rows.withColumns({name: F.coalesce(F.col(name), F.lit(False)) for name in ("quality", "toxic")})
    return rows.groupBy("part", "mask", F.col("quality").alias("good"), "toxic").agg(F.sum("n").alias("n"))


def path_counts(n_filters: int) -> tuple[list[int], list[int]]:
    """Orders that lead from the empty state to each state, and from each to the full one."""
    states = 1 << n_filters
    reaching, leaving = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):
        for bit in range(n_filters):
            if not state >> bit & 1:
                reaching[state | 1 << bit] += reaching[state]
    for state in reversed(range(states)):
        for bit in range(n_filters):
            if not state >> bit & 1:
                leaving[state] += leaving[state | 1 << bit]
    return reaching, leaving


def order_steps(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters, per part of ``failure_counts``.

    A part has at most four times as many counts as the lattice has states, whatever its documents.
    """
    size = len(filters)
    reaching, leaving = path_counts(size)
    orders = list(permutations(range(size)))

    def walked(cells: pd.DataFrame) -> pd.DataFrame:
        mask, n = cells["mask"].to_numpy(), cells["n"].to_numpy()
        by_label = np.stack([n, n * cells["good"].to_numpy(), n * cells["toxic"].to_numpy()])
        stays = [int(n[mask & state == 0].sum()) for state in range(1 << size)]
        fails = [int(n[mask >> bit & 1 == 1].sum()) for bit in range(size)]
        alone = [int(n[mask == 1 << bit].sum()) for bit in range(size)]
        edges, shapley = {}, [0] * size
        for state in range(1 << size):
            for bit in range(size):
                if not state >> bit & 1:
                    gone = by_label[:, (mask & state == 0) & (mask >> bit & 1 == 1)].sum(axis=1)
                    edges[state, bit] = gone.tolist()
                    shapley[bit] += reaching[state] * leaving[state | 1 << bit] * int(gone[0])
        part, rows = cells["part"].iloc[0], []
        for order in orders:
            state = 0
            for step, bit in enumerate(order, 1):
                removed, good, toxic = edges[state, bit]
                state |= 1 << bit
                name = "".join(filters[b] for b in order)
                rows.append((part, name, step, stays[state], removed, fails[bit] - removed, alone[bit], good, toxic, shapley[bit]))
        return pd.DataFrame(rows, columns=columns)

    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{name} bigint" for name in columns[3:])
    return counts.groupBy("part").applyInPandas(walked, schema)


def filter_interactions(docs: DataFrame, labels: DataFrame, part="lang", text="text", ident="doc_id", limits: Limits = Limits()) -> DataFrame:
    """All steps of all orders of the filters A to E over ``docs``, with the documents of each label that they lose."""
    return order_steps(failure_counts(docs, labels, part, text, ident, limits))
