"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their beginnings, present or not. From a bounded sample of labelled rows the features
are kept whose log odds between toxic and clean rows are far from zero. Severity grades come from
the labels and the amount of evidence: clean rows are grade 0, toxic ones are graded by how many kept features
they hold. The regression shares one weight per feature across all grades and has one threshold per
grade, in order: ``P(grade > k) = sigmoid(weights . features - threshold_k)``. It gives the expected
severity, and a text is toxic if it more likely has some grade than none.

Defined cases: null and empty texts have no features; rows without a label, id or text are not learned from; without toxic
or without clean rows nothing is toxic and severities are 0; repeated rows get equal results; an empty table gives an
empty result; texts of any length are read whole; an input column named like a result is replaced.
"""

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked
from tagmill.llm.samples import bounded
from tagmill.storage import lookup_join

WORDS = re.compile(r"[^\W\d_]+")
RESULTS = ["toxic", "score", "severity", "grade"]


class Settings(NamedTuple):
    # Bound of the sample, per label.
    rows_per_label: int = 3_000
    beginnings: tuple = (4, 5, 6)
    # A kept feature's log odds lie this many standard errors from zero.
    far: float = 3.0
    most_features: int = 20_000
    grades: int = 3
    epochs: int = 300
    rate: float = 0.3
    shrink: float = 1e-3


def features_of(word: str, settings: Settings) -> list[int]:
    """Features of one word, itself and its beginnings, as signed 32-bit hashes."""
    names = [word] + [f"{word[:n]}-" for n in settings.beginnings if len(word) > n]
    return [(zlib.crc32(name.encode()) ^ 0x80000000) - 0x80000000 for name in names]


def present(text: str | None, settings: Settings) -> np.ndarray:
    words = set(WORDS.findall(text.lower())) if text else ()
    return np.array(sorted({f for word in words for f in features_of(word, settings)}), np.int32)


class Model(NamedTuple):
    weights: dict
    thresholds: np.ndarray


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(rows: list, settings: Settings, totals: dict | None = None) -> Model:
    """A model from ``(toxic, features)``; ``totals`` has the labelled rows per label, beyond the sample."""
    nothing = Model({}, np.array([np.inf]))
    toxic = np.array([bool(row[0]) for row in rows])
    if not toxic.any() or toxic.all():
        return nothing
    # Only features of toxic rows can speak for toxicity; they are counted among clean rows too.
    counted = lambda label: np.unique(np.concatenate([found for y, found in rows if bool(y) == label]), return_counts=True)
    (names, in_toxic), (others, in_clean) = counted(True), counted(False)
    places = np.minimum(np.searchsorted(others, names), max(len(others) - 1, 0))
    same = others[places] == names if len(others) else np.zeros(len(names), bool)
    held = [np.where(same, in_clean[places] if len(others) else 0, 0), in_toxic]
    clean_n, toxic_n = int((~toxic).sum()), int(toxic.sum())
    odds = lambda held, n: (held + 0.5) / (n - held + 0.5)
    log_odds = np.log(odds(held[1], toxic_n)) - np.log(odds(held[0], clean_n))
    error = np.sqrt(1 / (held[1] + 0.5) + 1 / (toxic_n - held[1] + 0.5) + 1 / (held[0] + 0.5) + 1 / (clean_n - held[0] + 0.5))
    z = log_odds / error
    kept = np.flatnonzero((z >= settings.far) & (log_odds >= 3))
    kept = kept[np.argsort(-z[kept], kind="stable")][: settings.most_features]
    if not len(kept):
        return nothing
    column = {int(names[f]): i for i, f in enumerate(kept)}
    x = [np.array([column[f] for f in found.tolist() if f in column], np.int64) for _, found in rows]
    amount = np.array([len(found) for found in x])
    cuts = np.quantile(amount[toxic], np.arange(1, settings.grades) / settings.grades)
    grade = np.where(toxic, 1 + (amount[:, None] > np.unique(cuts)[None, :]).sum(axis=1), 0)
    top = int(grade.max())
    # Rows and columns of the present features, for sums over rows.
    row = np.repeat(np.arange(len(rows)), amount)
    col = np.concatenate(x) if amount.sum() else np.empty(0, np.int64)
    above = grade[:, None] > np.arange(top)[None, :]
    weights, first, gaps = np.zeros(len(kept)), 1.0, np.zeros(top - 1)
    memory = [np.full_like(weights, 1e-8), 1e-8, np.full_like(gaps, 1e-8)]
    # Each label weighs as much as it has labelled rows in all.
    totals = totals or {0: clean_n, 1: toxic_n}
    share = np.where(toxic, totals[1] / toxic_n, totals[0] / clean_n) / (totals[0] + totals[1])
    for _ in range(settings.epochs):
        thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        value = np.bincount(row, weights[col], len(rows))
        slope = (sigmoid(value[:, None] - thresholds[None, :]) - above) * share[:, None]
        by_row = slope.sum(axis=1)
        steps = [np.bincount(col, by_row[row], len(kept)) + settings.shrink * weights / len(kept), -slope.sum()]
        later = -slope.sum(axis=0)[::-1].cumsum()[::-1]
        steps.append(later[1:] * np.exp(gaps))
        for i, step in enumerate(steps):
            memory[i] = memory[i] + step**2
        weights = np.maximum(weights - settings.rate * steps[0] / np.sqrt(memory[0]), 0.0)
        first = first - settings.rate * steps[1] / np.sqrt(memory[1])
        gaps = gaps - settings.rate * steps[2] / np.sqrt(memory[2])
    thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return Model({int(f): float(w) for f, w in zip(names[kept], weights, strict=True) if w > 0}, thresholds)


def judged(text: str | None, model: Model, known: dict, settings: Settings) -> tuple:
    """``(toxic, score, severity, grade)`` of one text."""
    found = set()
    for word in set(WORDS.findall(text.lower())) if text else ():
        hits = known.get(word)
        if hits is None:
            hits = known[word] = tuple(f for f in features_of(word, settings) if f in model.weights)
        found.update(hits)
    chances = sigmoid(sum(model.weights[f] for f in sorted(found)) - model.thresholds) if model.weights else np.zeros(len(model.thresholds))
    return bool(chances[0] > 0.5), float(chances[0]), float(chances.sum()), int((chances > 0.5).sum())


def learn(docs: DataFrame, labels: DataFrame, label="toxic", text="text", ident="doc_id", settings: Settings = Settings()) -> Model:
    """Fit on at most ``rows_per_label`` rows per label; the driver gets feature numbers, not texts."""

    @F.arrow_udf("array<int>")
    def features(column: pa.Array) -> pa.Array:
        return pa.array([present(t.as_py(), settings) for t in column], pa.list_(pa.int32()))

    rows = labels.select(F.col(label).cast("int").alias("y"), F.col(ident).alias("i")).where("y IS NOT NULL AND i IS NOT NULL")
    totals = {row["y"]: row["count"] for row in rows.where("y IN (0, 1)").groupBy("y").count().collect()}
    sample = bounded(rows.where("y IN (0, 1)"), "y", "i", settings.rows_per_label)
    texts = docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    found = lookup_join(texts, sample, "i").select("y", "i", features("t").alias("f")).orderBy("i").toArrow().combine_chunks()
    lists = found["f"].combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    parts = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fitted(list(zip(found["y"].to_pylist(), parts, strict=True)), settings, totals)


def toxicity(docs: DataFrame, model: Model, text="text", settings: Settings = Settings()) -> DataFrame:
    """All input columns with ``toxic``, ``score`` (chance of any grade), ``severity`` (expected grade) and ``grade``."""

    @F.arrow_udf("struct<toxic:boolean,score:double,severity:double,grade:int>")
    def judge(column: pa.Array) -> pa.Array:
        known: dict = {}
        rows = []
        for value in column:
            if len(known) > 500_000:
                known.clear()
            rows.append(judged(value.as_py(), model, known, settings))
        kinds = (pa.bool_(), pa.float64(), pa.float64(), pa.int32())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=RESULTS)

    rows = packed(docs).withColumn("p", judge(F.col("doc").getField(text)))
    return unpacked(rows.select("doc", "p.*"), RESULTS)
