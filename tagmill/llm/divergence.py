"""How far the words of a source diverge from those of other sources and of its language.

Every text is read as bytes: one ``bytes.translate`` lowers A-Z and blanks every separator, ``bytes.split`` cuts, and
a ``Counter`` per document gives its frequencies. Counters of a language and source are added up in the worker, so a word
that fills the corpus leaves a task a few times only. One shuffle by language and term then brings the sparse
counts of a term together: one number per source that has it.

Sources are compared two by two over all kept terms without a table of all terms times all sources. A term
that a source lacks has the same ``p`` as any other such term, and among the terms a source has, many have equal counts. So
with ``f(p, q) = floor((p - q)^2 / q)`` and ``0`` marking the p of an absent term, the value of a pair is the sum

* over terms that both have, of ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``, from the row of the term, in numpy blocks;
* over the different p of each side, of their number times ``f(p, q0)`` and ``f(p0, q)``;
* of ``f(p0, q0)`` times the kept terms less those of either side.

Numbers are exact: decimals for p, 64-bit integers from there (p is at most 1 + scale, so a square is below 2^63).

Defined cases: null text, language or source count as empty strings; a text without terms counts for its group, which then has
its pairs; a language without kept terms gives pairs of value 0 and no term rows; repeated rows are documents of
their own; ties of value are ranked by item; texts of any length are read whole, in blocks; an empty table gives an empty result;
only text, language and source are read, so other columns cannot clash.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.storage import lookup_join, settle

#: Letters lowered, other bytes below 0x80 blanked, the rest (letters beyond ASCII) as they are.
LOWERED = bytes(c | 0x20 if chr(c).isascii() and chr(c).isalpha() else c if c >= 0x80 else 0x20 for c in range(256))
BLOCK = 1 << 22
MOST_HELD = 300_000
PAIR_BLOCK = 1 << 20


class Audit(NamedTuple):
    """Documents of a language that must hold a term, units of one in ``p``, terms listed per group."""

    min_docs: int = 3
    scale: int = 1_000_000_000
    top: int = 200


def frequencies(raw: bytes) -> Counter:
    """Terms of one UTF-8 text and how often they stand in it."""
    clean = raw.translate(LOWERED)
    if len(clean) <= BLOCK:
        return Counter(clean.split())
    found, at = Counter(), 0
    while at < len(clean):
        end = clean.find(b" ", at + BLOCK)
        end = len(clean) if end < 0 else end
        found.update(clean[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of ``docs`` (``lang, source, text``), summed within a task as far as memory allows."""

    def flushed(held):
        for (lang, source), (counts, texts) in held.items():
            size = len(counts)
            if size:
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(counts), pa.binary())]
                columns += [pa.array(counts.values(), pa.int64()), pa.array([texts[term] for term in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def count(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts, texts = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(counts)
                found = frequencies(raw.as_py())
                counts.update(found)
                texts.update(found.keys())
                size += len(counts)
                if size > MOST_HELD:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    found = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return found.mapInArrow(count, "lang string, source string, term binary, n bigint, docs bigint").withColumn("term", F.col("term").cast("string"))


def per_unit(count, total, scale: int):
    """``1 + floor(scale * (count + 1) / total)``, exact for any count."""
    return F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), F.greatest(total, F.lit(1))) + 1


def gap(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(terms: DataFrame) -> DataFrame:
    """``lang, a, b, value``: what the terms that both sources have add to their pair.

    Pairs within a term's row stay inside numpy blocks; a block leaves one sum per pair of sources.
    """

    def paired(batches):
        for batch in batches:
            entries = batch.column(1)
            sizes = np.diff(entries.offsets.to_numpy()).astype(np.int64)
            flat = entries.flatten()
            langs, lang_of = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            lang_of = np.repeat(lang_of, sizes)
            slot, p, p0 = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("slot", "p", "p0"))
            wide = int(slot.max(initial=0)) + 1
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # of the term, by entry
            upto = np.cumsum(np.repeat(sizes, sizes))  # pairs up to and with an entry
            total = int(upto[-1]) if len(upto) else 0
            for low in range(0, total, PAIR_BLOCK):
                number = np.arange(low, min(low + PAIR_BLOCK, total))
                a = np.searchsorted(upto, number, side="right")
                b = first[a] + (upto[a] - 1 - number)
                a, b = a[a != b], b[a != b]
                pa_, pa0, pb, pb0 = p[a], p0[a], p[b], p0[b]
                f = lambda x, y: (x - y) ** 2 // y
                value = f(pa_, pb) - f(pa_, pb0) - f(pa0, pb) + f(pa0, pb0)
                keys, at = np.unique((lang_of[a] * wide + slot[a]) * wide + slot[b], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, value)
                found = [pa.array(langs[keys // wide // wide], pa.string()), pa.array(keys // wide % wide), pa.array(keys % wide), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(found, names=["lang", "a", "b", "value"])

    return terms.select("lang", "entries").mapInArrow(paired, "lang string, a bigint, b bigint, value bigint")


def source_divergence(docs: DataFrame, text="text", language="lang", source="source", audit: Audit = Audit()) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and the leading terms of each source."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    docs = docs.select(empty(language).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    # A number per source within its language; a result row per pair of them is due anyway.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1
    groups = settle(docs.select("lang", "source").distinct().withColumn("slot", place), "groups")

    found = lookup_join(term_counts(docs), groups, ["lang", "source"]).select("lang", "term", "slot", "n", "docs")
    # Spread by term once: the sums per source, the documents per term and the row of a term need no further shuffle.
    found = found.repartition("lang", "term").groupBy("lang", "term", "slot").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = found.groupBy("lang", "term").agg(
        F.collect_list(F.struct("slot", "n")).alias("entries"), F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    kept = settle(kept.where(F.col("docs") >= audit.min_docs).drop("docs"), "terms")

    own = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.slot").alias("slot"))
    own = own.agg(F.sum("e.n").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)
    groups = lookup_join(lookup_join(groups, own, ["lang", "slot"], "left"), langs, "lang", "left")
    groups = groups.select("lang", "source", "slot", *map(zero, ("total", "terms", "kept", "lang_total")))
    none = F.lit(0).cast("bigint")
    groups = settle(groups.withColumn("p0", per_unit(none, F.col("total") + F.col("kept"), audit.scale)), "groups")

    sizes = groups.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "total", "kept", "p0"))), lambda g: F.struct((g["total"] + g["kept"]).alias("size"), g["p0"].alias("p0"))).alias("sizes"),
        F.max(F.col("lang_total") + F.col("kept")).alias("lang_size"),
    )
    at = lambda e: F.get("sizes", e["slot"].cast("int"))
    weigh = lambda e: F.struct(e["slot"].alias("slot"), per_unit(e["n"], at(e)["size"], audit.scale).alias("p"), at(e)["p0"].alias("p0"))
    terms = lookup_join(kept, sizes, "lang").select(
        "lang", "term", F.transform("entries", weigh).alias("entries"), per_unit(F.col("n"), F.col("lang_size"), audit.scale).alias("q")
    )

    # Pairs: what both have, what either has, what neither has.
    histogram = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.slot").alias("a"), F.col("e.p").alias("p"), F.col("e.p0").alias("p0"))
    histogram = settle(histogram.agg(F.count(F.lit(1)).alias("n")), "histogram")
    others = groups.select("lang", F.col("slot").alias("b"), F.col("p0").alias("q0"))
    one_sided = lookup_join(histogram, others, "lang", salts=1).where("a <> b")
    has_a = one_sided.select("lang", "a", "b", (F.col("n") * gap(F.col("p"), F.col("q0"))).alias("value"))
    has_b = one_sided.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") * gap(F.col("q0"), F.col("p"))).alias("value"))
    sides = groups.select("lang", "kept", F.col("slot").alias("a"), F.col("terms").alias("n_a"), F.col("p0").alias("pa"))
    facing = lookup_join(sides, groups.select("lang", F.col("slot").alias("b"), F.col("terms").alias("n_b"), F.col("p0").alias("pb")), "lang", salts=1)
    neither = facing.where("a <> b").select("lang", "a", "b", ((F.col("kept") - F.col("n_a") - F.col("n_b")) * gap(F.col("pa"), F.col("pb"))).alias("value"))
    parts = shared_terms(terms).union(has_a).union(has_b).union(neither)
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "slot", "source")
    named = lookup_join(pairs, names.withColumnRenamed("slot", "b").withColumnRenamed("source", "item"), ["lang", "b"])
    pairs = named.select("lang", F.col("a").alias("slot"), F.lit("pair").alias("part"), "item", "value")

    listed = terms.select("lang", "term", "q", F.explode("entries").alias("e")).where("e.p > q")
    listed = listed.select("lang", F.col("e.slot").alias("slot"), F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("e.p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "slot", "part").orderBy(F.col("value").desc(), "item"))
    leading = listed.withColumn("rank", rank).where(F.col("rank") <= audit.top)
    ranked = pairs.withColumn("rank", rank).union(leading)
    return lookup_join(ranked, names, ["lang", "slot"]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
