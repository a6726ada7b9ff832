"""TF-IDF features per subset as index and value arrays, and linear scores on them.

Every subset has its own vocabulary, a table of ``subset_id, term, idx, idf``. Texts are split in the JVM; a worker gets the
terms of a batch, finds their numbers in one vectorised lookup over the vocabularies of a group of subsets, and
weighs them per subset. Groups are cut so that what a pass broadcasts (vocabularies and, for scores, weights) stays below a
byte limit; more subsets take more passes over the rows.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.constants import ENGLISH_STOP_WORDS
from tagmill.operators.features import known_counts, pieces, vocabulary, with_words
from tagmill.operators.models import PASS_BYTES
from tagmill.storage import lookup_join

TERM_BYTES = 64


class Space(NamedTuple):
    """Terms of one subset: their sorted numbers in the group, places in the subset's vocabulary and IDF weights;
    for scores the labels, weights (a row per class) and intercepts."""

    codes: np.ndarray
    places: np.ndarray
    idf: np.ndarray
    labels: list
    weights: np.ndarray
    bias: np.ndarray

    def weighed(self, row: np.ndarray, code: np.ndarray, n: np.ndarray, size: int):
        """Row, place and unit-length TF-IDF weight of the counts of terms that the subset knows."""
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        row, at = row[known], at[known]
        value = n[known] * self.idf[at]
        length = np.sqrt(np.bincount(row, value * value, size))
        return row, self.places[at], value / length[row]


def subset_vocabulary(rows: DataFrame, max_features: int = 10_000, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Most frequent terms of every subset's rows with their IDF weights."""
    return vocabulary(rows, max_features, stop_words, by=["subset_id"]).select("subset_id", "term", "idx", "idf")


def groups(vocab: DataFrame, weights: DataFrame | None, pass_bytes: int):
    """``(terms, spaces)`` per group of subsets whose vocabularies and weights fit one broadcast."""
    each = vocab.groupBy("subset_id").agg(F.sum(F.length("term") + TERM_BYTES).alias("bytes"))
    if weights is not None:
        wide = weights.groupBy("subset_id").agg(F.sum(8 * F.size("coefficients")).alias("more"))
        each = lookup_join(wide, each, "subset_id", "left").withColumn("bytes", F.col("more") + F.coalesce("bytes", F.lit(0)))
    parts, used = [], 0
    for row in each.orderBy("subset_id").collect():  # one short row per subset
        if not parts or used + row["bytes"] > pass_bytes:
            parts.append([])
            used = 0
        parts[-1].append(row["subset_id"])
        used += row["bytes"]
    for part in parts:
        known = vocab.where(F.col("subset_id").isin(part)).select("subset_id", "term", "idx", "idf").toPandas()
        terms = np.unique(known["term"].to_numpy(object)) if len(known) else np.empty(0, object)
        fitted = None if weights is None else weights.where(F.col("subset_id").isin(part)).orderBy("subset_id", "class_idx").toPandas()
        spaces = {}
        for subset in part:
            own = known[known["subset_id"] == subset]
            codes = np.searchsorted(terms, own["term"].to_numpy(object))
            order = np.argsort(codes)
            labels, matrix, bias = [], np.empty((0, 0)), np.empty(0)
            if fitted is not None:
                mine = fitted[fitted["subset_id"] == subset]
                labels, bias = list(mine["label"]), mine["intercept"].to_numpy()
                matrix = np.zeros((len(mine), max(len(own), *mine["coefficients"].map(len))))
                for at, line in enumerate(mine["coefficients"]):
                    matrix[at, : len(line)] = line
            spaces[subset] = Space(codes[order], own["idx"].to_numpy(np.int64)[order], own["idf"].to_numpy()[order], labels, matrix, bias)
        yield terms.tolist(), spaces


def _passes(rows, vocab, weights, keep, own, stop_words, schema, finish, pass_bytes) -> DataFrame:
    """Run ``finish(batch, kept rows, subset, space, row, place, value)`` for every batch and subset, group by group."""
    spark = rows.sparkSession

    def run(shared):
        def each(batches):
            terms, spaces = shared.value
            known = pa.array(terms, pa.string())
            for batch in (piece for whole in batches for piece in pieces(whole)):
                row, code, n = known_counts(batch.column("_words"), known)
                owner = np.array(batch.column("subset_id").to_pylist(), object) if own else None
                for subset, space in spaces.items():
                    mine = np.flatnonzero(owner == subset) if own else np.arange(batch.num_rows)
                    if not len(mine):
                        continue
                    r, place, value = space.weighed(row, code, n, batch.num_rows)
                    if own:
                        renumber = np.full(batch.num_rows, -1)
                        renumber[mine] = np.arange(len(mine))
                        inside = renumber[r] >= 0
                        r, place, value = renumber[r[inside]], place[inside], value[inside]
                    kept = [batch.column(name).take(pa.array(mine)) for name in keep]
                    columns = [*kept, pa.array([subset] * len(mine), pa.string()), *finish(space, len(mine), r, place, value)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return each

    needed = with_words(rows, list(dict.fromkeys([*keep, *(["subset_id"] if own else [])])), stop_words)
    out = None
    for group in groups(vocab, weights, pass_bytes):
        mine = needed.where(F.col("subset_id").isin(list(group[1]))) if own else needed
        part = mine.mapInArrow(run(spark.sparkContext.broadcast(group)), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def lists_of(row: np.ndarray, size: int, values: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def sparse_features(rows: DataFrame, vocab: DataFrame, keep=("row_id",), own: bool = True, stop_words=ENGLISH_STOP_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``keep`` columns, ``subset_id, indices, values`` of texts in the vocabulary of their own subset, or of each."""
    schema = T.StructType([*rows.select(*keep).schema, T.StructField("subset_id", T.StringType())])
    schema = schema.add("indices", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.DoubleType()))

    def finish(space, size, row, place, value):
        order = np.lexsort((place, row))
        return lists_of(row, size, place[order].astype(np.int32), pa.int32()), lists_of(row, size, value[order], pa.float64())

    return _passes(rows, vocab, None, list(keep), own, stop_words, schema, finish, pass_bytes)


def score_sparse(
    rows: DataFrame, vocab: DataFrame, weights: DataFrame, keep=("row_id",), own: bool = False, arrays: bool = True,
    stop_words=ENGLISH_STOP_WORDS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Every row's ``text`` against every subset model, with the columns of ``score_linear``."""
    schema = T.StructType([*rows.select(*keep).schema, T.StructField("subset_id", T.StringType())])
    schema = schema.add("predicted_label", T.StringType()).add("uncertainty", T.DoubleType()).add("max_probability", T.DoubleType())
    if arrays:
        schema = schema.add("labels", T.ArrayType(T.StringType())).add("probabilities", T.ArrayType(T.DoubleType()))

    def finish(space, size, row, place, value):
        share = np.stack([np.bincount(row, value * w[place], size) for w in space.weights], axis=1) + space.bias
        share = np.exp(share - share.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        bits = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1.0)), 0.0).sum(axis=1)
        best = np.array(space.labels, object)[share.argmax(axis=1)]
        columns = [pa.array(best, pa.string()), pa.array(bits), pa.array(share.max(axis=1))]
        if arrays:
            offsets = pa.array(np.arange(size + 1, dtype=np.int32) * len(space.labels))
            names = pa.array(space.labels * size, pa.string())
            columns += [pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(share.ravel()))]
        return columns

    if weights.isEmpty():
        raise ValueError("no trained classifier")
    return _passes(rows, vocab, weights, list(keep), own, stop_words, schema, finish, pass_bytes)


def as_vectors(rows: DataFrame, size: int) -> DataFrame:
    """MLlib's ``features`` from ``indices, values``, for estimators that want it."""
    made = F.udf(lambda indices, values: SparseVector(size, indices, values), VectorUDT())
    return rows.withColumn("features", made("indices", "values"))


def moved_between(rows: DataFrame, keep) -> DataFrame:
    """``keep`` columns and the point at ``_step`` of the way from ``indices, values`` to ``_other`` (of the same names)."""
    schema = T.StructType([*rows.select(*keep).schema]).add("indices", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.DoubleType()))

    def side(indices, values, scale):
        row = np.repeat(np.arange(len(scale)), np.diff(indices.offsets.to_numpy()))
        return row, indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False) * scale[row]

    def move(batches):
        for batch in batches:
            step = batch.column("_step").to_numpy()
            other = batch.column("_other")
            a = side(batch.column("indices"), batch.column("values"), 1 - step)
            b = side(pc.struct_field(other, "indices"), pc.struct_field(other, "values"), step)
            row, place, value = (np.concatenate(pair) for pair in zip(a, b, strict=True))
            wide = int(place.max(initial=0)) + 1
            cell, at = np.unique(row.astype(np.int64) * wide + place, return_inverse=True)
            total = np.bincount(at, value, len(cell))
            found = lists_of(cell // wide, len(step), (cell % wide).astype(np.int32), pa.int32()), lists_of(cell // wide, len(step), total, pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in keep], *found], names=schema.names)

    return rows.select(*keep, "indices", "values", "_other", "_step").mapInArrow(move, schema)
