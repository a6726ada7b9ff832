"""TF-IDF and encoder vectors."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.constants import ENGLISH_STOP_WORDS
from tagmill.functions.text import strip_space, text_key, tokens, with_pairs, without
from tagmill.storage import SALTS, as_lookup, estimated_bytes, lookup_join, only_needed, settle, split_join


def with_terms(rows: DataFrame, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Add ``_terms``: words and word pairs of the text. Words get a column of their
    own first, so that they are split once."""
    split = rows.withColumn("_words", without(tokens(F.col("text")), stop_words))
    return split.withColumn("_terms", with_pairs(F.col("_words"))).drop("_words")


def with_words(rows: DataFrame, keep, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``keep`` columns and ``_words`` of the text; no words without a text."""
    words = F.coalesce(without(tokens(F.col("text")), stop_words), F.array().cast("array<string>"))
    return rows.select(*keep, words.alias("_words"))


# Words of a batch that are numbered at a time.
WORDS = 1_000_000
# Bytes of a table of texts whose terms are ranked in one part.
RANKED_BYTES = 16 * 1024 * 1024


def pieces(batch: pa.RecordBatch):
    """Parts of a batch with about ``WORDS`` words each; a row stays whole."""
    if not batch.num_rows:
        return
    words = np.cumsum(np.diff(batch.column("_words").offsets.to_numpy())) // WORDS
    cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


class Terms:
    """Words and word pairs of a batch as numbers: below ``wide`` a word, above it a pair of two words."""

    def __init__(self, lists: pa.ListArray):
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        self.words, self.wide = coded.dictionary, len(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        follows = row[1:] == row[:-1]
        pair = self.wide + word[:-1][follows] * self.wide + word[1:][follows]
        self.row, self.code = np.concatenate([row, row[:-1][follows]]), np.concatenate([word, pair])

    def counts(self):
        """Row, number and count of every term of every row, sorted by row and number."""
        return counted(self.row, self.code, self.wide * (self.wide + 1))

    def named(self, code: np.ndarray) -> pa.Array:
        """Terms with these numbers, which are in order."""
        cut = int(np.searchsorted(code, self.wide))
        pair = code[cut:] - self.wide
        first, second = (self.words.take(pa.array(part)) for part in np.divmod(pair, max(self.wide, 1)))
        return pa.concat_arrays([self.words.take(pa.array(code[:cut])), pc.binary_join_element_wise(first, second, " ")])

    def numbered(self, terms: pa.Array) -> np.ndarray:
        """Numbers of given terms in this batch, -1 for those that cannot occur."""
        parts = pc.split_pattern(terms, " ", max_splits=1)
        several = pc.list_value_length(parts).to_numpy(zero_copy_only=False) > 1
        flat, starts = parts.flatten(), parts.offsets.to_numpy()[:-1]
        at = pc.index_in(flat, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        first, second = at[starts], at[np.minimum(starts + 1, max(len(at) - 1, 0))]
        pair = np.where((first >= 0) & (second >= 0), self.wide + first * self.wide + second, -1)
        return np.where(several, pair, first)


def counted(row: np.ndarray, code: np.ndarray, wide: int):
    """Row, code and count of every different pair of a row and a code below ``wide``."""
    cell, n = np.unique(row * wide + code, return_counts=True)
    return cell // max(wide, 1), cell % max(wide, 1), n


def known_counts(lists: pa.ListArray, terms: pa.Array):
    """Row, place in ``terms`` and count of the given terms in the words of every row, sorted by row."""
    found = Terms(lists)
    if not len(found.code) or not len(terms):
        return (np.empty(0, np.int64),) * 3
    number = found.numbered(terms)
    order = np.argsort(number, kind="stable")
    at = np.minimum(np.searchsorted(number, found.code, sorter=order), len(order) - 1)
    known = number[order[at]] == found.code
    return counted(found.row[known], order[at[known]], len(terms))


def term_totals(rows: DataFrame, stop_words=ENGLISH_STOP_WORDS, by=()) -> DataFrame:
    """``by`` columns, ``term``, its number ``tf`` and in how many rows ``df`` it is. A batch of texts is summed up before the shuffle."""
    by = list(by)
    schema = T.StructType([*rows.select(*by).schema]).add("term", T.StringType()).add("tf", T.LongType()).add("df", T.LongType())

    def totals(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            found = Terms(batch.column("_words"))
            row, code, n = found.counts()
            if not len(row):
                continue
            keys = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in by]
            _, first, group = np.unique(np.stack([np.zeros(batch.num_rows, np.int64), *keys]), axis=1, return_index=True, return_inverse=True)
            wide = found.wide * (found.wide + 1)
            cell, at, df = np.unique(group.ravel()[row] * wide + code, return_inverse=True, return_counts=True)
            tf = np.bincount(at, n, len(cell)).astype(np.int64)
            owner, term = cell // wide, cell % wide
            for one in range(len(first)):
                mine = slice(*np.searchsorted(owner, [one, one + 1]))
                size = len(term[mine])
                own = [batch.column(c).take(pa.array(np.full(size, first[one]))) for c in by]
                yield pa.RecordBatch.from_arrays([*own, found.named(term[mine]), pa.array(tf[mine]), pa.array(df[mine])], names=schema.names)

    parts = with_words(rows, by, stop_words).mapInArrow(totals, schema)
    return parts.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def term_counts(rows: DataFrame, terms: list, stop_words=ENGLISH_STOP_WORDS, keep=()) -> DataFrame:
    """``keep`` columns, ``term`` and ``n`` for every one of the given terms in every row."""
    schema = T.StructType([*rows.select(*keep).schema]).add("term", T.StringType()).add("n", T.LongType())
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def counts(batches):
        known = pa.array(shared.value, pa.string())
        for batch in (piece for whole in batches for piece in pieces(whole)):
            row, place, n = known_counts(batch.column("_words"), known)
            kept = [batch.column(c).take(pa.array(row)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, known.take(pa.array(place)), pa.array(n.astype(np.int64))], names=schema.names)

    return with_words(rows, keep, stop_words).mapInArrow(counts, schema)


def best_of_parts(totals: DataFrame, by, order, most: int, parts: int) -> DataFrame:
    """The first ``most`` terms of each part of a group, by the hash of the term: no task sorts all terms of a group."""
    dealt = totals.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank", "_part")


def vocabulary(rows: DataFrame, max_features: int = 10_000, stop_words=ENGLISH_STOP_WORDS, by=()) -> DataFrame:
    """Most frequent terms with their number, document frequency and IDF weight.

    One pass over the texts; totals are pre-aggregated per batch of texts and per task.
    """
    by = list(by)
    totals = term_totals(rows, stop_words, by)
    order = [F.desc("tf"), F.col("term")]
    if by:
        near = best_of_parts(totals, by, order, max_features, max(SALTS, -(-estimated_bytes(rows) // RANKED_BYTES)))
        ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        chosen = ranked.where(F.col("_rank") <= max_features).withColumn("idx", F.col("_rank") - 1).drop("_rank")
    else:
        top = totals.orderBy(*order).limit(max_features)
        chosen = top.withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)
    docs = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_docs"))
    weighted = lookup_join(chosen, docs, by) if by else chosen.withColumn("_docs", F.lit(docs.first()[0]))
    return settle(weighted.withColumn("idf", F.log((F.col("_docs") + 1) / (F.col("df") + 1)) + 1).drop("_docs"), "vocabulary")


def tfidf(rows: DataFrame, vocab: DataFrame, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Long form: unit-length TF-IDF weights per row and term.

    Terms outside the vocabulary go before the one shuffle, which carries one short
    line per row and term. The vocabulary, of at most ``max_features`` terms, reaches every task.
    """
    known = as_lookup(vocab.select("term", "idx", "idf"), "vocabulary")
    terms = [r["term"] for r in known.table.select("term").distinct().collect()]
    hits = lookup_join(term_counts(rows, terms, stop_words, ["row_id"]), known, "term")
    raw = hits.withColumn("_w", F.col("n") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("row_id")))
    return raw.select("row_id", "term", "idx", (F.col("_w") / size).alias("weight"))


def tfidf_vectors(rows: DataFrame, vocab: DataFrame, stop_words=ENGLISH_STOP_WORDS, out: str = "features") -> DataFrame:
    """The same weights as one MLlib vector per row, without a shuffle.

    The vocabulary reaches the driver; it has at most ``max_features`` terms.
    """
    listed = vocab.orderBy("idx").select("term", "idf").collect()
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in listed], inputCol="_terms", outputCol="_tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in listed]), inputCol="_tf", outputCol="_raw")
    unit = Normalizer(p=2.0, inputCol="_raw", outputCol=out)
    split = with_terms(rows, stop_words)
    return unit.transform(scale.transform(counter.transform(split))).drop("_terms", "_tf", "_raw")


def hashed_vectors(rows: DataFrame, dims: int = 64) -> DataFrame:
    """Built-in encoder inside the JVM: hashed words and word pairs, unit length."""
    split = with_terms(rows, ())
    counted = HashingTF(numFeatures=dims, inputCol="_terms", outputCol="_tf").transform(split)
    scaled = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_unit").cast("array<float>")).drop("_terms", "_tf", "_unit")


class WordPlaces(dict):
    """Place of a word by its md5: below ``dims`` it counts up, above it counts down.

    Words are remembered for the life of a worker; the memory is emptied before it grows large.
    """

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        digest = hashlib.md5(word.encode()).hexdigest()
        place = int(digest[:8], 16) % self.dims + (0 if digest[8] < "8" else self.dims)
        self[word] = place
        return place


PLACES: dict[int, WordPlaces] = {}


def word_hash_encoder(dims: int = 64):
    """Python encoder: signed word counts hashed by md5 and scaled to length one."""

    def encode(texts):
        import re

        import numpy as np

        word = re.compile(r"\w\w+")
        places = PLACES.setdefault(dims, WordPlaces(dims))
        out = np.zeros((len(texts), dims))
        for at, text in enumerate(texts):
            found = np.fromiter(map(places.__getitem__, word.findall(text.lower())), np.int64)
            counts = np.bincount(found, minlength=2 * dims)
            out[at] = counts[:dims] - counts[dims:]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1.0)

    return encode


def encode_texts(rows: DataFrame, encoder, model: str) -> DataFrame:
    """Run an encoder (texts to matrix) over ``key, text`` in Arrow batches."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            vectors = np.asarray(encoder(batch["text"].to_list()), dtype=np.float32)
            yield pd.DataFrame({"key": batch["key"], "model": model, "embedding": list(vectors)})

    return rows.select("key", "text").mapInPandas(run, "key string, model string, embedding array<float>")


def cache_misses(rows: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts without a cached vector of this model.

    Texts are reduced to one per key before anything else, so copies do not pile up.
    """
    distinct = rows.select(text_key(F.col("text")).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    known = only_needed(cache.where(F.col("model") == model).select("key"), distinct, "key")
    return distinct.join(known, "key", "left_anti")


def cache_hits(rows: DataFrame, cache: DataFrame, model: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Rows with their cached vector."""
    keyed = rows.withColumn("key", text_key(F.col("text")))
    known = only_needed(cache.where(F.col("model") == model), keyed, "key")
    return split_join(keyed, known.dropDuplicates(["key"]).select("key", "embedding"), "key", "inner", hot_rows)


def embed_texts(rows: DataFrame, cache: DataFrame, encoder, model: str, strict: bool = False):
    """Vectors for all rows and the newly encoded cache entries.

    New vectors are written before use, so a retry does not call the encoder again.
    ``strict`` rejects blank texts.
    """
    if strict and not rows.where(F.coalesce(strip_space(F.col("text")), F.lit("")) == "").isEmpty():
        raise ValueError("text must not be empty")
    fresh = settle(encode_texts(cache_misses(rows, cache, model), encoder, model), "encoded")
    return cache_hits(rows, cache.unionByName(fresh), model), fresh


EMPTY_CACHE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
