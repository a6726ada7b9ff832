"""The judge: cached verdicts, prompts, replies.

A judge is a callable from a list of prompts to a list of replies. It runs in the
Python workers, one Arrow batch at a time; a reply may be None for a failed request.
"""

from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.constants import NOISE_LABEL, VALIDATOR_SYSTEM
from tagmill.functions.prompts import binary_prompt, chat_request, default_description, describe_prompt
from tagmill.functions.replies import verdict
from tagmill.functions.text import strip_space, text_key
from tagmill.operators.neighbours import knn_join
from tagmill.operators.sampling import sample_examples
from tagmill.sources.cache import Cache
from tagmill.sources.requests import RequestLog
from tagmill.storage import fresh_path, lasting, lookup_join, only_needed, settle, split_join, temporary

PAIR = ["text_md5", "predicted_label"]
VERDICT = ["is_valid", "confidence", "reply", "error", "n_examples", "description"]
CACHE_SCHEMA = (
    "text_md5 string, predicted_label string, is_valid boolean, confidence double, reply string, "
    "error string, n_examples int, description string"
)
EXAMPLES = "examples array<string>"
ROWS_PER_TASK = 2_000
# Requests that a task asks, and logs, at a time: what a lost task may have to ask again.
ROWS_PER_CHUNK = 200
# Cells whose texts and examples are on their way at a time: more cells take more passes, and the disk of a pass is bounded.
PASS_CELLS = 256


def verdict_cache(path: str, keep_examples: bool = False) -> Cache:
    """The verdicts under a path, by text and label."""
    return Cache(path, tuple(PAIR), f"{CACHE_SCHEMA}, {EXAMPLES}" if keep_examples else CACHE_SCHEMA)


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text_md5", text_key(F.col("text")))


def cache_split(rows: DataFrame, cache: DataFrame | Cache, hot_rows: int = 1_000_000, keep_examples: bool = False) -> DataFrame:
    """Rows with their cached verdict, if any, and a ``cached`` flag."""
    pairs = keyed(rows)
    known = cache.found(pairs) if isinstance(cache, Cache) else only_needed(cache, pairs, PAIR).dropDuplicates(PAIR)
    if keep_examples and "examples" not in known.columns:
        known = known.withColumn("examples", F.array().cast("array<string>"))
    known = known.select(*PAIR, *VERDICT, *["examples"] * keep_examples, F.lit(True).alias("cached"))
    joined = split_join(pairs, known, PAIR, "left", hot_rows)
    return joined.withColumn("cached", F.coalesce("cached", F.lit(False)))


def ask(prompts: DataFrame, judge, log: str | None = None, chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``reply`` and ``error`` to rows with a ``prompt``.

    A task asks ``chunk`` requests at a time and logs the replies before it asks the next ones, so a task that is lost and
    tried again asks only what it has no reply to. The log is new for each call, unless a folder is given: a later
    call over the same partitions of prompts goes on there. When a chunk fails all its open rows carry the error and no
    reply. The answers are written before anything reads them, so later work never repeats a request.
    """
    log = log or fresh_path(prompts.sparkSession, "requests")
    columns = [c for c in prompts.columns if c != "prompt"]
    schema = prompts.select(*columns).schema.add("reply", "string").add("error", "string")

    def run(batches):
        answers = None
        for batch in batches:
            for start in range(0, len(batch), chunk):
                some = batch.iloc[start : start + chunk]
                answers = answers or RequestLog(log, TaskContext.get().partitionId())
                replies, error = answers.answered(some["prompt"].to_list(), judge)
                out = some[columns].copy()
                out["reply"] = replies
                out["error"] = [None if r is not None else error or "request failed" for r in replies]
                yield out

    return settle(prompts.mapInPandas(run, schema), "replies")


def dealt_by_label(rows: DataFrame, size: int = ROWS_PER_TASK // 2) -> tuple[DataFrame, int]:
    """Rows with a ``_cell`` of about ``size`` rows, and the number of cells. Rows of a label lie in as few cells as they fill."""
    counts = rows.groupBy("predicted_label").agg((F.count(F.lit(1)) / size).alias("_share"))
    before = Window.orderBy("predicted_label").rowsBetween(Window.unboundedPreceding, -1)  # one short row per label
    shares = settle(counts.withColumn("_start", F.coalesce(F.sum("_share").over(before), F.lit(0.0))), "shares")
    total = shares.agg(F.coalesce(F.sum("_share"), F.lit(0.0))).first()[0]
    cells = max(1, int(-(-total // 1)))
    # labels may be null
    known = shares.withColumnRenamed("predicted_label", "_label").withColumn("_none", F.col("_label").isNull()).fillna("", ["_label"])
    keyed = rows.withColumns({"_none": F.col("predicted_label").isNull(), "_label": F.coalesce("predicted_label", F.lit(""))})
    drawn = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    cell = F.least(F.floor(F.col("_start") + F.col("_share") * drawn), F.lit(cells - 1)).cast("int")
    joined = lookup_join(keyed, known, ["_none", "_label"])
    return joined.withColumn("_cell", cell).drop("_none", "_label", "_start", "_share"), cells


def attached(rows: DataFrame, lists: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """In parts of ``PASS_CELLS`` cells, rows with the ``examples`` that their ``query_id`` has in ``lists``, as ``_items`` by rank; the texts of these are in ``texts``.

    Rows are dealt to tasks by label, and a task gets each text that its rows need once, however many rows name it. The texts
    come first, then the lists, then the rows, so a task holds the texts of one cell and passes rows on.
    """
    dealt, cells = dealt_by_label(rows)
    lists = settle(lists.join(dealt.select("query_id", "_cell").distinct(), "query_id"), "lists")

    def ordered(start, end):
        asked, known = (part.where(F.col("_cell").between(start, end - 1)) for part in (dealt, lists))
        needed = known.select("_cell", F.explode("_items").alias("item_id")).distinct().join(texts, "item_id")
        return (
            needed.select("_cell", F.lit(0).alias("_kind"), F.col("item_id").alias("_item"), "_example")
            .unionByName(known.select("_cell", F.lit(1).alias("_kind"), "query_id", "_items"), allowMissingColumns=True)
            .unionByName(asked.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
            .repartitionById(end - start, F.col("_cell") - start)
            .sortWithinPartitions("_kind")
        )

    schema = T.StructType([*rows.schema, T.StructField("examples", T.ArrayType(T.StringType()))])
    names = rows.columns

    def attach(batches):
        held, found = {}, {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_CHUNK):
                part = batch.slice(start, ROWS_PER_CHUNK)
                kind = part.column("_kind").to_numpy()
                first, last = part.filter(pa.array(kind == 0)), part.filter(pa.array(kind == 1))
                for item, text in zip(first.column("_item").to_pylist(), first.column("_example").to_pylist(), strict=True):
                    held.setdefault(item, []).append(text)
                for query, items in zip(last.column("query_id").to_pylist(), last.column("_items").to_pylist(), strict=True):
                    found[query] = items
                own = part.filter(pa.array(kind == 2))
                if own.num_rows:
                    # of rows with one id the null texts come first, as in a sorted array
                    lists = [
                        [text for item in found.get(query, ()) for text in sorted(held.get(item, ()), key=lambda t: (t is not None, t))]
                        for query in own.column("query_id").to_pylist()
                    ]
                    columns = [own.column(name) for name in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.string()))], names=schema.names)

    starts = range(0, cells, PASS_CELLS)
    return [ordered(start, min(start + PASS_CELLS, cells)).mapInArrow(attach, schema) for start in starts]


def example_parts(rows: DataFrame, labelled: DataFrame, k: int, index=None) -> list[DataFrame]:
    """Attach the texts of the ``k`` nearest labelled rows of the predicted label; the rows come in one or more parts.

    ``rows`` has ``query_id, predicted_label, vector``; ``labelled`` has
    ``row_id, label, text, vector``. With an ``index`` (``VectorIndex``) the labelled rows are read from it, by cell.
    """
    if index is not None:
        near = index.nearest(rows.select("query_id", F.col("predicted_label").alias("label"), "vector"), k)
        found = near.select("query_id", "rank", F.col("text").alias("_example"))
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "_example"))), lambda x: x["_example"])
        lists = found.groupBy("query_id").agg(ordered.alias("examples"))
        empty = F.array().cast("array<string>")
        return [rows.join(lists, "query_id", "left").withColumn("examples", F.coalesce("examples", empty))]
    corpus = labelled.select(F.col("row_id").alias("item_id"), F.col("label").alias("predicted_label"), "vector")
    near = knn_join(rows.select("query_id", "predicted_label", "vector"), corpus, k, on=["predicted_label"])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"])
    lists = near.groupBy("query_id").agg(in_order.alias("_items"))
    return attached(rows, lists, labelled.select(F.col("row_id").alias("item_id"), F.col("text").alias("_example")))


def with_examples(rows: DataFrame, labelled: DataFrame, k: int, index=None) -> DataFrame:
    """The parts of ``example_parts`` as one table."""
    return reduce(DataFrame.unionByName, example_parts(rows, labelled, k, index))


def with_description(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Attach the description of the predicted label, or the default one."""
    known = descriptions.select(F.col("label").alias("predicted_label"), F.col("description").alias("_description"))
    return (
        lookup_join(rows, known, "predicted_label", "left")
        .withColumn("description", F.coalesce("_description", default_description(F.col("predicted_label"))))
        .drop("_description")
    )


def prompt_parts(rows: DataFrame, labelled: DataFrame, descriptions: DataFrame, k: int, index=None) -> list[DataFrame]:
    """Rows of ``query_id, text, predicted_label, vector`` with their ``prompt``, in the parts of ``example_parts``."""
    parts = example_parts(with_description(rows, descriptions), labelled, k, index)
    prompt = binary_prompt(F.col("text"), F.col("predicted_label"), F.col("description"), F.col("examples"), k)
    return [ready.withColumn("prompt", prompt).withColumn("n_examples", F.size("examples")) for ready in parts]


def validation_prompts(rows: DataFrame, labelled: DataFrame, descriptions: DataFrame, k: int, index=None) -> DataFrame:
    """The parts of ``prompt_parts`` as one table."""
    return reduce(DataFrame.unionByName, prompt_parts(rows, labelled, descriptions, k, index))


def judge_batch(
    rows, cache, labelled, descriptions, judge, k: int = 6, hot_rows: int = 1_000_000, style: str | None = "messages",
    keep_examples: bool = False, log: str | None = None, index=None,
):
    """Verdicts for ``row_id, text, predicted_label, vector``.

    The judge gets whole requests, as JSON in the given ``style``: system prompt, worked
    pairs and the prompt; without a style it gets the bare prompt.

    Each (text, label) pair without a cached verdict is asked once, however many rows
    share it. Returns all rows with verdicts and the new cache rows; failed requests
    are not cached. With ``keep_examples`` both also have the ``examples`` that the judge saw; cached verdicts have those
    they were stored with, none if they were stored without. ``log`` is a folder for replies, see ``ask``;
    ``index`` a stored index of the labelled rows, see ``example_parts``.
    """
    kept = ["examples"] * keep_examples
    with temporary(rows.sparkSession, "judging"):
        split = cache_split(rows, cache, hot_rows, keep_examples)
        with lasting():
            split = settle(split, "split")
        one = split.where("NOT cached").groupBy(*PAIR).agg(
            F.min_by(F.struct("text", "vector"), "row_id").alias("_row"), F.min("row_id").alias("query_id")
        )
        misses = settle(one.select("query_id", *PAIR, "_row.text", "_row.vector"), "misses")
        parts = []
        for prompts in prompt_parts(misses, labelled, descriptions, k, index):
            if style is not None:
                prompts = prompts.withColumn("prompt", chat_request(VALIDATOR_SYSTEM, F.col("prompt"), style))
            asked = prompts.select(*PAIR, "n_examples", "description", *kept, "prompt")
            # Partitions by key, so that an attempt finds in the log what an earlier one asked; without an index they are cells already,
            # and the prompts, several times the texts, are not shuffled.
            if index is not None:
                asked = asked.repartition(max(1, -(-misses.count() // ROWS_PER_TASK)), *PAIR)
            with lasting():
                parts.append(ask(asked, judge, log))
    replies = reduce(DataFrame.unionByName, parts)
    fresh = replies.withColumn("_v", verdict(F.col("reply"))).select(*PAIR, "_v.*", "reply", "error", "n_examples", "description", *kept)
    base = split.drop(*VERDICT, *kept).where("NOT cached")
    answered = split_join(base, fresh, PAIR, "left", hot_rows)
    results = split.where("cached").unionByName(answered)
    return results, fresh.where(F.col("error").isNull())


def example_lists(labelled: DataFrame, max_examples: int = 50, shown: int = 10, seed: int = 42) -> DataFrame:
    """First examples per label and the number drawn."""
    drawn = sample_examples(labelled.select("row_id", "label", "text"), max_examples, seed)
    listed = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "text")))), lambda x: x["text"]
    )
    return drawn.groupBy("label").agg(listed.alias("examples"), F.count(F.lit(1)).alias("n_examples"))


def describe_labels(labels, labelled, judge=None, max_examples: int = 50, seed: int = 42) -> DataFrame:
    """One description per label, written by the judge from sampled examples.

    Without a judge, without examples or after a failed request the default text is
    used.
    """
    wanted = labels.select("label").distinct()
    default = default_description(F.col("label"))
    if judge is None:
        return wanted.select("label", default.alias("description"))
    lists = lookup_join(example_lists(labelled, max_examples, seed=seed), wanted, "label", "left_semi")
    prompts = lists.where(F.col("label") != NOISE_LABEL).select(
        "label", describe_prompt(F.col("label"), F.col("examples"), F.col("n_examples")).alias("prompt")
    )
    replies = ask(prompts, judge).select("label", strip_space(F.col("reply")).alias("_written"))
    return lookup_join(wanted, replies, "label", "left").select("label", F.coalesce("_written", default).alias("description"))


def validation_summary(log: DataFrame, *by: str) -> DataFrame:
    """Counts and rates over a verdict log; cached rows are no validations."""
    fresh, failed = ~F.col("cached"), F.col("error").isNotNull()
    counts = log.groupBy(*by).agg(
        F.count_if(fresh).alias("total_validations"),
        F.count_if(fresh & ~failed & F.col("is_valid")).alias("valid_predictions"),
        F.count_if(fresh & ~failed & ~F.col("is_valid")).alias("invalid_predictions"),
        F.count_if(fresh & failed).alias("request_errors"),
        F.count_if(~fresh).alias("cache_hits"),
    )
    total = F.col("total_validations")
    return counts.withColumns(
        {
            "validation_accuracy": F.try_divide("valid_predictions", total),
            "error_rate": F.try_divide("request_errors", total),
            "cache_hit_rate": F.try_divide("cache_hits", total),
        }
    )
