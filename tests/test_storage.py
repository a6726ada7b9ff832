import os

from pyspark.sql import functions as F

from tagmill import storage


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def skewed(spark):
    """A third of all rows has one key."""
    return spark.range(900).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key")
    )


def test_salted_join_equals_broadcast(spark):
    rows = skewed(spark)
    lookup = rows.select("key").distinct().where("key <> 'k1'").withColumn("n", F.length("key"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = storage.lookup_join(rows, storage.Lookup(lookup, True), "key", how)
        large = storage.lookup_join(rows, storage.Lookup(lookup, False), "key", how, salts=5)
        assert rows_of(small) == rows_of(large), how


def test_a_large_lookup_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "KNOWN_SMALL_BYTES", 0)
    monkeypatch.setattr(storage, "LOOKUP_ROWS", 3)
    lookup = storage.as_lookup(skewed(spark).select("key").distinct())
    assert not lookup.small
    joined = storage.lookup_join(skewed(spark), lookup, "key")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and joined.count() == 900


def test_repeated_rows_of_a_large_lookup_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "KNOWN_SMALL_BYTES", 0)
    monkeypatch.setattr(storage, "LOOKUP_ROWS", 3)
    rows = spark.range(0, 1000, 1, 2).withColumn("n", F.col("id") % 7)
    lookup = storage.as_lookup(spark.range(500))  # of so few bytes that Catalyst would broadcast all 32 copies
    for how, n in (("inner", 500), ("left", 1000), ("left_semi", 500), ("left_anti", 500)):
        joined = storage.lookup_join(rows, lookup, "id", how)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString(), how
        assert joined.count() == n


def test_tables_of_a_temporary_block_go_and_lasting_ones_stay(spark):
    with storage.temporary(spark, "block"):
        gone = storage.settle(spark.range(3))
        with storage.lasting():
            kept = storage.settle(spark.range(4))
        assert gone.count() == 3
        inside = gone.inputFiles()[0]
    assert kept.count() == 4 and not os.path.exists(inside.removeprefix("file://"))
    assert storage.settle(spark.range(5)).count() == 5


def test_split_join_keeps_every_row(spark):
    rows = skewed(spark)
    matches = rows.select("key").distinct().where("key <> 'k2'").withColumn("n", F.length("key"))
    for how in ("left", "inner"):
        plain = rows.join(matches, "key", how)
        split = storage.split_join(rows, matches, "key", how, hot_rows=100)
        assert rows_of(plain) == rows_of(split), how


def test_pair_with_makes_the_grid(spark):
    left, right = spark.range(4), spark.range(3).withColumnRenamed("id", "other")
    assert storage.pair_with(left, right, "other").count() == 12
    assert storage.pair_with(left, right.where("other < 0"), "other").count() == 0


def test_repeat_rows_over_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(storage, "CHUNK", 3)
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 7)], "id long, copies long")
    found = storage.repeat_rows(rows, "copies", ["id"], "copy").collect()
    assert sorted((r["id"], r["copy"]) for r in found) == [(i, c) for i, n in ((2, 1), (3, 3), (4, 7)) for c in range(1, n + 1)]


def test_work_dir_is_the_configured_folder(spark):
    assert storage.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
