"""Caches read by key, and logs of requests."""

import os

import pytest

from tagmill.operators import judge
from tagmill.sources.cache import Cache
from tagmill.sources.requests import RequestLog
from tagmill.storage import fresh_path

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_cache_by_key(spark):
    cache = Cache(fresh_path(spark, "cache"), ("k",), SCHEMA, buckets=8)
    asked = rows(spark, *[(f"k{i}", 0) for i in range(5)], (None, 0), ("k1", 9))
    got = lambda c=cache: sorted((r.k, r.v) for r in c.found(asked).collect())
    assert got() == [] and cache.rows(spark).count() == 0
    cache.compact(spark)
    cache.add(rows(spark), 0)
    assert got() == []
    cache.add(rows(spark, *[(f"k{i}", i) for i in range(200)], ("k3", 3), (None, 7)), 1)
    assert got() == [(f"k{i}", i) for i in range(5)]
    cache.add(rows(spark, ("k2", 20)), 2)
    cache.add(rows(spark, ("k2", 21)), 2)  # a repeated addition replaces itself
    wanted = [("k0", 0), ("k1", 1), ("k2", 21), ("k3", 3), ("k4", 4)]
    assert got() == wanted and got(cache._replace(before=2)) == [(f"k{i}", i) for i in range(5)]
    cache.compact(spark)
    assert got() == wanted and cache.rows(spark).count() == 201
    assert "Exchange" not in cache.rows(spark)._jdf.queryExecution().executedPlan().toString()
    cache.add(rows(spark, ("k0", 5)), 3)
    assert got() == [("k0", 5), *wanted[1:]] and cache.rows(spark).count() == 201
    assert got(cache._replace(before=3)) == wanted


def test_lookup_opens_only_folders_that_can_hold_its_keys(spark):
    cache = Cache(fresh_path(spark, "cache"), ("k",), SCHEMA, buckets=8)
    cache.add(rows(spark, *[(f"k{i}", i) for i in range(200)]), 1)
    one = cache.found(rows(spark, ("k7", 0)))
    assert [r.v for r in one.collect()] == [7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert len({os.path.dirname(f) for f in cache.stored(spark).inputFiles()}) == 8


def test_log_asks_once(tmp_path):
    asked = []

    def answer(prompts):
        asked.extend(prompts)
        return [None if p == "bad" else p.upper() for p in prompts]

    log = RequestLog(str(tmp_path), 0)
    assert log.answered(["a", "b", "a", "bad"], answer) == (["A", "B", "A", None], None)
    again = RequestLog(f"file:{tmp_path}", 0)
    assert again.answered(["b", "c", "bad"], answer) == (["B", "C", None], None)
    assert asked == ["a", "b", "bad", "c", "bad"]
    assert again.answered(["a", "d"], lambda prompts: []) == (["A", None], "judge returned another number of replies")
    assert again.answered([], answer) == ([], None)


def test_killed_task_asks_no_prompt_twice(spark, tmp_path):
    answered, killed = str(tmp_path / "answered"), str(tmp_path / "killed")

    def dying(prompts):
        if os.path.exists(answered) and not os.path.exists(killed):
            open(killed, "w").close()
            os._exit(1)
        with open(answered, "a") as out:
            out.writelines(f"{p}\n" for p in prompts)
        return ["True"] * len(prompts)

    prompts = spark.range(50).selectExpr("id", "concat('p', id) AS prompt").repartition(1, "id")
    log = fresh_path(spark, "requests")
    with pytest.raises(Exception, match="(?i)worker|crash|exited"):
        judge.ask(prompts, dying, log, chunk=10)
    found = judge.ask(prompts, dying, log, chunk=10)
    assert found.where("reply = 'True' AND error IS NULL").count() == 50
    asked = open(answered).read().split()
    assert len(asked) == 50 and len(set(asked)) == 50


def test_examples_are_kept_with_verdicts(spark):
    made = spark.createDataFrame([(i, f"t{i}", "a", [1.0, float(i)]) for i in range(4)], "row_id long, text string, predicted_label string, vector array<double>")
    labelled = spark.createDataFrame([(9, "near", "a", [1.0, 0.0])], "row_id long, text string, label string, vector array<double>")
    none = spark.createDataFrame([], "label string, description string")
    cache = judge.verdict_cache(fresh_path(spark, "verdicts"), keep_examples=True)
    say = lambda prompts: ["True"] * len(prompts)
    first, fresh = judge.judge_batch(made.limit(2), cache, labelled, none, say, 2, keep_examples=True)
    assert [list(r.examples) for r in first.collect()] == [["near"], ["near"]]
    cache.add(fresh, 0)
    results, _ = judge.judge_batch(made, cache, labelled, none, say, 2, keep_examples=True)
    assert sorted((r.cached, list(r.examples)) for r in results.collect()) == [(False, ["near"])] * 2 + [(True, ["near"])] * 2
    without = spark.createDataFrame([], judge.CACHE_SCHEMA)
    assert judge.judge_batch(made, without, labelled, none, say, 2, keep_examples=True)[0].where("size(examples) = 1").count() == 4
    assert "examples" not in judge.judge_batch(made, without, labelled, none, say, 2)[0].columns
