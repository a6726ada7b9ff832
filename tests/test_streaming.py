import uuid
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from tagmill.operators import judge as judging
from tagmill.sources.cache import Cache
from tagmill.streaming import arrivals


def test_state_asks_each_pair_once_and_failed_ones_again(spark, tmp_path, monkeypatch):
    asked, open_again, source, out = tmp_path / "asked", tmp_path / "well", str(tmp_path / "in"), str(tmp_path / "out")
    asked.mkdir()

    def judge(prompts):
        (asked / uuid.uuid4().hex).write_text("\n".join(prompts))
        return [None if "odd" in p and not open_again.exists() else "True" for p in prompts]

    def calls():
        return Counter(line for f in Path(asked).iterdir() for line in f.read_text().split("\n"))

    def run(*files, keep="30 days"):
        for rows in files:
            frame = spark.createDataFrame(rows, "row_id long, text string, predicted_label string")
            frame.coalesce(1).write.mode("append").parquet(source)
        schema = "row_id long, text string, predicted_label string"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        arrivals.stream_judge_once(spark, stream, judge, lambda t, l: F.concat_ws("/", t, l), out, keep)

    def no_reading(*_):
        raise AssertionError("a micro-batch reads earlier verdicts")

    with monkeypatch.context() as patched:
        patched.setattr(Cache, "stored", no_reading)
        run([(1, "one", "a"), (2, "one", "a"), (3, "odd", "a")], [(4, "one", "a"), (5, "one", "b"), (6, None, "a"), (7, "two", None)])
        assert calls() == {"one/a": 1, "odd/a": 1, "one/b": 1}
        # A restarted stream: the failed pair, still failing, is asked again though nobody sends it; known ones are not.
        run([(8, "one", "b"), (9, "odd", "a"), (10, "new", "a")])
        assert calls() == {"one/a": 1, "odd/a": 2, "one/b": 1, "new/a": 1}
        open_again.write_text("")
        run()
        run([(11, "odd", "a")])
        assert calls() == {"one/a": 1, "odd/a": 3, "one/b": 1, "new/a": 1}
    rows = spark.createDataFrame([(1, "one", "a"), (2, "odd", "a"), (3, "none", "a")], "row_id long, text string, predicted_label string")
    found = {r["row_id"]: (r["cached"], r["is_valid"]) for r in judging.cache_split(rows, judging.verdict_cache(f"{out}/verdicts")).collect()}
    assert found == {1: (True, True), 2: (True, True), 3: (False, None)}


def test_state_forgets_after_its_time(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "text string, predicted_label string"
    for _ in range(3):
        spark.createDataFrame([("one", "a")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        arrivals.stream_judge_once(spark, stream, lambda p: ["True" for _ in p], lambda t, l: F.concat_ws("/", t, l), out, "0 seconds")
    numbers = judging.verdict_cache(f"{out}/verdicts").numbers(spark, "iteration")
    assert len(numbers) >= 2


def test_a_stream_without_rows_writes_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], "text string, predicted_label string").write.parquet(source)
    stream = spark.readStream.schema("text string, predicted_label string").parquet(source)
    arrivals.stream_judge_once(spark, stream, lambda p: 1 / 0, lambda t, l: t, out)
    assert not (tmp_path / "out" / "verdicts").exists()
