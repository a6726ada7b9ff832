"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean embedding of its byte n-grams, hashed into buckets; a linear softmax
over it gives the languages. Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows per language. As mean and softmax weights are linear, prediction needs one table of
bucket times language, and the n-grams of whole texts are looked up in it batch by batch. A share of the
sample is kept from training to calibrate: a temperature makes the score a probability, and a prediction whose score is
below nearly all right ones of that share is marked as rejected.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; without any
labelled row every text is; rows without a language, id or text are not learned from; repeated rows get equal predictions; an
empty table gives an empty result; texts of any length are read whole; an input column named like a result is replaced.
"""

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked
from tagmill.llm.samples import bounded

UNKNOWN = "und"
# Letters and some numbers that are no digits, such as a raised two; among these, letters are told by ``isalpha``.
LETTER = re.compile(r"[^\W\d_]")
PAD = b"   "
# Spreads the bytes of an n-gram; fixed values.
SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


class Settings(NamedTuple):
    # Bound of the sample, per language.
    rows_per_language: int = 400
    bucket_bits: int = 14
    orders: tuple = (2, 3, 4)
    width: int = 16
    epochs: int = 12
    rate: float = 0.5
    calibration_share: float = 0.2
    rejected_share: float = 0.01
    seed: int = 7


# ASCII bytes that are no letters become spaces; others stay.
BLANKED = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def grams(raw: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams that begin at each byte (the last ones excepted)."""
    code = np.full(len(raw) - order + 1, order * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        code = (code ^ raw[i : len(raw) - order + 1 + i]) * SPREAD[i]
        code ^= code >> np.uint32(15)
    return code >> np.uint32(32 - bits)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, blanks between them; where each begins and ends."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    raw = BLANKED[np.frombuffer(b" " + b"".join(p + PAD + b" " for p in parts), np.uint8)]
    starts = np.concatenate(([0], np.cumsum(lengths + len(PAD) + 1)[:-1])) if len(parts) else np.empty(0, np.int64)
    return raw, starts, starts + lengths + 1


def counted(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    raw, _, ends = laid_out([text])
    found = np.concatenate([grams(raw, n, settings.bucket_bits)[: ends[0]] for n in settings.orders])
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, counts / counts.sum()


class Model(NamedTuple):
    languages: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fitted(rows: list, settings: Settings) -> Model:
    """A model from ``(language, buckets, shares)``."""
    languages = sorted({row[0] for row in rows})
    if not languages:
        return Model([], np.zeros((1 << settings.bucket_bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    draw = np.random.default_rng(settings.seed)
    truth = np.array([languages.index(row[0]) for row in rows])
    held = draw.random(len(rows)) < settings.calibration_share
    learned = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    embedding = draw.normal(0, 1 / settings.width, (1 << settings.bucket_bits, settings.width))
    weights, bias = np.zeros((settings.width, len(languages))), np.zeros(len(languages))
    steps, done = settings.epochs * len(learned), 0
    for _ in range(settings.epochs):
        for i in draw.permutation(learned):
            rate = settings.rate * (1 - done / steps)
            done += 1
            _, buckets, shares = rows[i]
            hidden = shares @ embedding[buckets]
            error = softmax(hidden @ weights + bias)
            error[truth[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            # The mean spreads a step over all buckets, so their common rate is larger.
            embedding[buckets] -= rate * settings.width * np.outer(shares, back)
    table = embedding @ weights
    judged = np.flatnonzero(held) if held.any() else learned
    logits = np.array([rows[i][2] @ table[rows[i][1]] + bias for i in judged])
    losses = {}
    for temperature in np.geomspace(0.05, 5, 40):
        chance = softmax(logits / temperature)[np.arange(len(judged)), truth[judged]]
        losses[temperature] = -np.log(np.maximum(chance, 1e-12)).mean()
    temperature = min(losses, key=losses.get)
    best = softmax(logits / temperature)
    right = best.max(axis=1)[best.argmax(axis=1) == truth[judged]]
    least = float(np.quantile(right, settings.rejected_share)) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, float(temperature), least)


def predicted(texts: list[str | None], model: Model, settings: Settings) -> list[tuple]:
    """``(language, score, rejected)`` of each text."""
    out = [(UNKNOWN, 0.0, True)] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(m[0].isalpha() for m in LETTER.finditer(t))] if model.languages else []
    at = 0
    while at < len(known):
        # About a megabyte at once bounds the memory; a longer text goes alone.
        end, size = at, 0
        while end < len(known) and (end == at or size + len(texts[known[end]]) <= 500_000):
            size += len(texts[known[end]])
            end += 1
        raw, starts, ends = laid_out([texts[i] for i in known[at:end]])
        total = np.zeros((end - at, len(model.languages)))
        edges = np.stack((starts, ends), axis=1).ravel()
        for order in settings.orders:
            found = grams(raw, order, settings.bucket_bits)
            for j in range(len(model.languages)):
                total[:, j] += np.add.reduceat(model.table[:, j][found], edges, dtype=np.float64)[::2]
        mean = total / (len(settings.orders) * (ends - starts))[:, None]
        chance = softmax((mean + model.bias) / model.temperature)
        for row, i in enumerate(known[at:end]):
            best = int(chance[row].argmax())
            score = float(chance[row, best])
            out[i] = (model.languages[best], score, score < model.least)
        at = end
    return out


def learn(labelled: DataFrame, language="lang", text="text", ident="doc_id", settings: Settings = Settings()) -> Model:
    """Fit on at most ``rows_per_language`` rows per language; the driver gets bucket counts, not texts."""

    @F.arrow_udf("struct<buckets:array<int>,shares:array<double>>")
    def features(column: pa.Array) -> pa.Array:
        found = [counted(t.as_py(), settings) for t in column]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(b) for b, _ in found]))).astype(np.int32))
        join = lambda part, kind: np.concatenate([np.asarray(f[part], kind) for f in found]) if found else np.empty(0, kind)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(join(i, kind))) for i, kind in ((0, np.int32), (1, np.float64))]
        return pa.StructArray.from_arrays(lists, names=["buckets", "shares"])

    rows = labelled.select(F.col(language).alias("l"), F.col(text).alias("t"), F.col(ident).alias("i"))
    sample = bounded(rows.where("l IS NOT NULL AND i IS NOT NULL AND t IS NOT NULL AND t RLIKE '\\\\p{L}'"), "l", "i", settings.rows_per_language)
    found = sample.select("l", "i", features("t").alias("f")).select("l", "i", "f.*").orderBy("l", "i").toArrow().combine_chunks()
    buckets, shares = (found[name].combine_chunks() for name in ("buckets", "shares"))
    ends = buckets.offsets.to_numpy()
    parts = [(buckets.values.to_numpy()[a:b], shares.values.to_numpy()[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fitted([(name, *part) for name, part in zip(found["l"].to_pylist(), parts, strict=True)], settings)


def identify(docs: DataFrame, model: Model, text="text", settings: Settings = Settings()) -> DataFrame:
    """All input columns with ``lang_pred, score, rejected``."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(column: pa.Array) -> pa.Array:
        rows = predicted(column.to_pylist(), model, settings)
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang_pred", "score", "rejected"])

    rows = packed(docs).withColumn("p", predict(F.col("doc").getField(text)))
    return unpacked(rows.select("doc", "p.*"), ["lang_pred", "score", "rejected"])
