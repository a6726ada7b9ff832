import hashlib

import pytest
from pyspark.sql import functions as F

from tagmill.operators import sampling


def draw(row_id, seed=42):
    return hashlib.md5(f"{seed}:{row_id}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """One label holds a third of the rows, one a single row."""
    label = F.when(F.col("id") == 7, F.lit("one")).when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("l"), F.col("id") % 5)
    )
    return spark.range(600).select(F.col("id").alias("row_id"), label.alias("label"))


def expected(rows, quota):
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["label"], []).append(r["row_id"])
    return {x for ids in groups.values() for x in sorted(ids, key=draw)[: quota(len(ids))]}


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("k", [0, 1, 17, 200, 10_000])
def test_lowest_per_group(rows, k, digits, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED_ROWS", 5 if digits == 1 else 10_000)
    found = sampling.take_lowest(rows, ["label"], ["row_id"], k, digits=digits)
    assert {r["row_id"] for r in found.collect()} == expected(rows, lambda n: k)


def test_quota_by_table(spark, rows):
    quota = spark.createDataFrame([("hot", 5), ("l1", 0)], "label string, quota long")
    found = sampling.take_lowest(rows, ["label"], ["row_id"], quota).collect()
    assert len(found) == 5 and {r["label"] for r in found} == {"hot"}


def test_sample_of_the_whole_table(rows):
    found = {r["row_id"] for r in sampling.sample_rows(rows, 50).collect()}
    assert found == set(sorted(range(600), key=draw)[:50])


def test_fraction_split_covers_all_rows(rows):
    found = sampling.fraction_split(rows, ["label"], ["row_id"])
    train = {r["row_id"] for r in found.where("is_train").collect()}
    assert found.count() == 600
    assert train == expected(rows, lambda n: n if n < 2 else (n * 80 + 50) // 100)


def test_train_and_pool_are_disjoint_and_complete(rows):
    found = sampling.train_pool_split(rows, 30, 50).collect()
    kept = rows.where("label <> 'one'").count()
    assert len(found) == kept and len({r["row_id"] for r in found}) == kept


def test_number_rows_is_dense(spark):
    rows = spark.range(1000).where("id % 7 <> 0").withColumnRenamed("id", "row_id")
    found = sampling.number_rows(rows.repartition(5), "row_id").orderBy("row_id").collect()
    assert [r["position"] for r in found] == list(range(len(found)))
    assert sampling.batch_slice(sampling.number_rows(rows, "row_id"), 100, 3).count() == 100


def test_splits_for_several_sizes(rows):
    found = sampling.experiment_splits(rows, 50, (5, 150, 100_000))
    counts = {(r["per_class"], r["role"]): r["n"] for r in found.groupBy("per_class", "role").agg(F.count("*").alias("n")).collect()}
    big = [n for n in (r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect())]
    assert counts[(5, "train")] == 5 * sum(n >= 5 for n in big)
    assert counts[(150, "train")] == 150 * sum(n >= 150 for n in big)
    assert counts[(100_000, "train")] == 600  # no class is large enough: the largest ones, all rows
