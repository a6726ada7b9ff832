"""Scoring and judging of arriving texts, micro-batch by micro-batch.

Each batch writes its own folders by batch id, so a repeated batch replaces itself.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.operators import judge as judging
from tagmill.operators.cleaning import drop_noise
from tagmill.operators.models import most_uncertain, score_linear
from tagmill.sources import state
from tagmill.storage import settle


def _run(arrivals: DataFrame, handle, checkpoint: str) -> None:
    query = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_score(arrivals: DataFrame, vectorise, weights: DataFrame, out: str, k: int) -> None:
    """Score arriving ``row_id, text`` and queue the ``k`` most uncertain of a batch.

    ``vectorise`` adds ``vector`` to a batch.
    """

    def handle(batch, batch_id):
        predictions = settle(drop_noise(score_linear(vectorise(batch), weights, arrays=False)), "scored")
        state.append_rows(predictions, out, "predictions", batch_id)
        queue = most_uncertain(predictions.select("row_id", "subset_id", "predicted_label", "uncertainty"), k)
        state.append_rows(queue, out, "queue", batch_id)

    _run(arrivals, handle, f"{out}/checkpoint")


def stream_judge(arrivals: DataFrame, judge, prompt, out: str) -> None:
    """Judge arriving ``row_id, text, predicted_label`` once per (text, label).

    Pairs answered in an earlier batch come from the cache; within a batch only one
    row of a pair is asked. A micro-batch opens only the folders of the cache that can hold its pairs; a batch that is repeated
    does not see its own answers there, but goes on with its log of requests. ``prompt`` makes the prompt column.
    """
    verdicts = judging.verdict_cache(f"{out}/verdicts")

    def handle(batch, batch_id):
        cache = verdicts._replace(before=batch_id)
        split = settle(judging.cache_split(batch, cache), "split")
        once = split.where("NOT cached").dropDuplicates(judging.PAIR)
        prompts = once.select(*judging.PAIR, prompt(F.col("text"), F.col("predicted_label")).alias("prompt"))
        tasks = max(1, -(-prompts.count() // judging.ROWS_PER_TASK))
        asked = judging.ask(prompts.repartition(tasks, *judging.PAIR), judge, f"{out}/requests/batch={batch_id}")
        fresh = asked.withColumn("_v", judging.verdict(F.col("reply"))).select(
            *judging.PAIR, "_v.*", "reply", "error", F.lit(0).alias("n_examples"), F.lit("").alias("description")
        )
        cache.add(fresh.where(F.col("error").isNull()), batch_id)
        log = split.groupBy("cached").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*judging.PAIR).alias("pairs"))
        state.append_rows(log, out, "batches", batch_id)

    _run(arrivals, handle, f"{out}/checkpoint")


RETRY = "text string, predicted_label string, attempt int"


def stream_judge_once(spark: SparkSession, arrivals: DataFrame, judge, prompt, out: str, keep: str = "30 days", attempts: int = 5) -> None:
    """Judge arriving ``text, predicted_label`` once per pair; the pairs asked before are kept as streaming state.

    The state has digest and label of a pair, no texts, and forgets it when it was not asked for ``keep`` (by arrival, within
    twice that time); a pair that comes again later is asked again. A micro-batch reads no verdicts: it writes its new ones to
    ``out/verdicts``, where ``cache_split`` finds them by key. Pairs whose request failed go to ``out/failed``, which later runs of
    the stream read as further arrivals, until ``attempts`` requests were made. A batch that is repeated goes on with its log of requests.

    Defined cases: rows without text or label are left out; a stream without rows writes nothing. A large state belongs into the RocksDB store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    verdicts = judging.verdict_cache(f"{out}/verdicts")
    again = spark.readStream.schema(RETRY).option("ignoreMissingFiles", "true").parquet(f"{out}/failed/batch-*")
    rows = arrivals.select("text", "predicted_label", F.lit(0).alias("attempt")).unionByName(again)
    pairs = judging.keyed(rows.where("text IS NOT NULL AND predicted_label IS NOT NULL")).withColumn("arrived", F.current_timestamp())
    # One string that is never null: the schema of the state must not depend on which of the two sources has rows.
    pairs = pairs.withColumn("pair", F.concat_ws("/", "text_md5", "attempt", "predicted_label"))
    first = pairs.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["pair"]).drop("arrived", "pair")

    def handle(batch, batch_id):
        asked = settle(batch, "unseen")  # the state is read and written once
        count = asked.count()
        if not count:
            return
        prompts = asked.withColumn("prompt", prompt(F.col("text"), F.col("predicted_label")))
        dealt = prompts.repartition(-(-count // judging.ROWS_PER_TASK), *judging.PAIR)
        replies = judging.ask(dealt, judge, f"{out}/requests/batch={batch_id}")
        fresh = replies.where("error IS NULL").withColumn("_v", judging.verdict(F.col("reply"))).select(
            *judging.PAIR, "_v.*", "reply", "error", F.lit(0).alias("n_examples"), F.lit("").alias("description")
        )
        verdicts.add(fresh, batch_id)
        failed = replies.where(F.col("error").isNotNull() & (F.col("attempt") + 1 < attempts))
        path = f"{out}/failed/batch-{batch_id}"
        if not failed.isEmpty() or state.exists(spark, path):
            failed.select("text", "predicted_label", (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").parquet(path)

    _run(first, handle, f"{out}/checkpoint")
