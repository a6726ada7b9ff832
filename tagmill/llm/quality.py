"""Quality rules with thresholds that adapt to each language and source.

Every text is measured once. The shares it yields (symbols, repeated lines, repeated words) and
its mean word length go into histogram sketches with about 3 % relative width, one per language,
source and measure. Sketches are counts per cell, so they merge by addition: the language's own
sketch is the sum of its sources' sketches. A fence lies some spreads beyond the quartiles, and a
document is rejected when a measure lies beyond the fence of its source and of its language.

``SHARP``, the rules of ``quality_rules`` and the pipeline, can reject on every measure and side: repeats below the base limit,
and word lengths on a ratio scale. The SQL of ``op7_quality_rules`` states ``Rules()``, by which the fence of repeats lies at
the base limit or beyond, and the lower one of word lengths mostly below 0, so these two hardly act there.

Defined cases: a null or empty text has no words, so the base rule rejects it; a null language or
source is a group of its own; repeated rows are measured and kept alike; an empty table gives an
empty result; texts of any length are measured whole; an input column named like one of the
results is replaced.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import group_key, packed, unpacked
from tagmill.storage import lookup_join, settle

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
WINDOW = 8


class Rules(NamedTuple):
    """Base limits, and how far beyond the quartiles a fence lies."""

    min_words: int = 20
    max_repeat_percent: int = 30
    spreads: int = 6
    # Smallest spread that counts, per measure, in parts of a million (word length: thousandths).
    floors: tuple = (("symbols", 10_000), ("dup_lines", 60_000), ("repeats", 50_000), ("length", 1_000))
    # Whether the spread of word lengths is q3 / q1 - 1 (floor in thousandths) and its fences are multiples.
    ratio: bool = False


SHARP = Rules(floors=(("symbols", 3_000), ("dup_lines", 40_000), ("repeats", 30_000), ("length", 100)), ratio=True)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more."""
    count = len(words)
    if count <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(word, len(ids)) for word in words), np.uint64, count)
    if len(ids) == count:
        return 0
    # Windows by a 64-bit hash, built by doubling from single words to eight.
    code = (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    width = 1
    while width < WINDOW:
        code = code[:-width] * np.uint64(0x94D049BB133111EB) + code[width:]
        code ^= code >> np.uint64(31)
        width *= 2
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    edges = np.zeros(count + 1, np.int64)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges)[:count] > 0).sum())


def measure_text(raw: bytes | None) -> tuple:
    """The six counts of one UTF-8 text."""
    if not raw:
        return (0,) * len(COUNTS)
    words = raw.split()  # bytes split at ASCII white space only
    chars = len(raw.decode("utf-8", "replace")) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (all input columns) with the counts of its whole text."""

    @F.arrow_udf("struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">")
    def counts(raw: pa.Array) -> pa.Array:
        rows = [measure_text(value.as_py()) for value in raw]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)

    rows = packed(docs).withColumn("m", counts(F.col("doc").getField(text).cast("binary")))
    return rows.select("doc", *[F.col(f"m.{name}").alias(name) for name in COUNTS])


def measures():
    """Integer measures, so that any engine computes the same ones."""
    share = lambda part, whole: F.floor(F.col(part) * 1_000_000 / F.greatest(F.col(whole), F.lit(1))).cast("bigint")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "length": F.floor(F.col("word_chars") * 1_000 / F.greatest(F.col("n_words"), F.lit(1))).cast("bigint"),
    }


def cell(value):
    """Lower end of a value's cell: exact below 64, then 32 cells per power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``q1, q3`` per group and measure: the cells in which those ranks lie.

    A sketch has at most some hundred cells per measure, whatever its rows.
    """
    cells = sketch.groupBy(*by, "measure", "cell").agg(F.sum("rows").alias("rows"))
    group = Window.partitionBy(*by, "measure")
    ranked = cells.select(
        *by, "measure", "cell",
        F.sum("rows").over(group.orderBy("cell")).alias("upto"),
        F.sum("rows").over(group).alias("total"),
    )
    at = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("total") * part, F.col("cell")))
    return ranked.groupBy(*by, "measure").agg(at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, by: list[str], rules: Rules, prefix: str) -> DataFrame:
    """One row per group: ``{prefix}_{measure}`` above which, and for word length also
    ``{prefix}_short`` below which, a measure is out of bounds."""
    spread = F.greatest(F.col("q3") - F.col("q1"), F.col("floor"))
    floor = F.coalesce(*[F.when(F.col("measure") == name, F.lit(least)) for name, least in rules.floors])
    found = quartiles(sketch, by).withColumn("floor", floor.cast("bigint"))
    high = F.col("q3") + spread * rules.spreads
    low = F.col("q1") - spread * rules.spreads
    if rules.ratio:
        length = F.col("measure") == "length"
        wide = F.greatest(F.col("q3") / F.col("q1") - 1, F.col("floor") / 1_000) + 1
        times = F.pow(wide, F.lit(rules.spreads))
        high = F.when(length, F.col("q3") * times).otherwise(high)
        low = F.when(length, F.col("q1") / times)
    sides = [F.max(F.when(F.col("measure") == name, high)).alias(f"{prefix}_{name}") for name, _ in rules.floors]
    return found.groupBy(*by).agg(*sides, F.max(F.when(F.col("measure") == "length", low)).alias(f"{prefix}_short"))


def judged(counted: DataFrame, language: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the rows of ``measured`` (written before: read twice)."""
    rows = counted.withColumn("g", group_key(F.col("doc").getField(language), F.col("doc").getField(source)))
    rows = rows.withColumn("l", group_key(F.col("doc").getField(language)))
    parts = F.array(*[F.struct(F.lit(name).alias("measure"), cell(value).alias("cell")) for name, value in measures().items()])
    base_failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    passed = rows.where(~base_failed).select("g", "l", F.explode(parts).alias("x")).select("g", "l", "x.*")
    sketch = settle(passed.groupBy("g", "l", "measure", "cell").agg(F.count(F.lit(1)).alias("rows")), "sketch")
    own, whole = fences(sketch, ["g"], rules, "own"), fences(sketch, ["l"], rules, "all")
    both = lookup_join(lookup_join(rows, own, "g", "left"), whole, "l", "left")
    values = measures()
    beyond = (values["length"] < F.col("own_short")) & (values["length"] < F.col("all_short"))
    for name, _ in rules.floors:
        beyond = beyond | ((values[name] > F.col(f"own_{name}")) & (values[name] > F.col(f"all_{name}")))
    return both.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~F.coalesce(beyond, F.lit(False)))


def quality_rules(docs: DataFrame, text="text", language="lang", source="source", rules: Rules = SHARP) -> DataFrame:
    """All input columns, the six counts, ``base_failed`` and ``kept``."""
    counted = settle(measured(docs, text), "measured")
    return unpacked(judged(counted, language, source, rules), [*COUNTS, "base_failed", "kept"])
