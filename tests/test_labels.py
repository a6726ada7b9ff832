import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagmill.constants import NOISE_LABEL
from tagmill.operators import labelspace, mapping as maps


def greedy(names, vectors, size):
    """Plain twin: least cosine to the mean of the current subset."""
    free, out, current = sorted(names), [], []
    while free:
        if not current or len(current) == size:
            current = [free[0]]
            out.append(current)
        else:
            mean = np.mean([vectors[x] for x in current], axis=0)
            cosines = [np.dot(mean, vectors[x]) / (np.linalg.norm(mean) * np.linalg.norm(vectors[x])) for x in free]
            current.append(free[int(np.argmin(cosines))])
        free.remove(current[-1])
    return out


@settings(max_examples=4, deadline=None)
@given(count=st.integers(1, 14), size=st.integers(1, 9), seed=st.integers(0, 99))
def test_greedy_subsets_equal_the_plain_form(spark, count, size, seed):
    rng = np.random.default_rng(seed)
    vectors = {f"l{i:02d}": rng.normal(size=5) for i in range(count)}
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "label string, vector array<double>")
    found = maps.nested_mapping(labelspace.greedy_subsets(frame, size)).collect()
    wanted = greedy(list(vectors), vectors, size)
    assert {r["subset_id"]: r["labels"] for r in found} == {f"subset_{i}": s for i, s in enumerate(wanted)}
    assert all(len(s) <= size for s in wanted)


def test_large_taxonomies_are_split_alike(spark):
    """Equal and zero vectors included: ties fall to the first label, whatever way a taxonomy takes."""
    rng = np.random.default_rng(8)
    rows = []
    for lang, count in (("a", 9), ("b", 5), (None, 3)):
        some = [rng.normal(size=4).tolist() for _ in range(count)]
        some[2] = some[1]
        some[-1] = [0.0] * 4
        rows += [(lang or "none", f"l{i:02d}", v) for i, v in enumerate(some)]
    frame = spark.createDataFrame(rows, "lang string, label string, vector array<double>")

    def split(limit):
        return sorted(map(tuple, labelspace.greedy_subsets(frame, 3, ["lang"], limit).select("lang", "subset_id", "pos", "label").collect()))

    assert split(0) == split(5 * (8 * 4 + 64)) == split(1 << 20) and len(split(0)) == 17


def test_greedy_per_taxonomy(spark):
    frame = spark.range(6).select(
        (F.col("id") % 2).alias("lang"), F.col("id").cast("string").alias("label"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector")
    )
    found = labelspace.greedy_subsets(frame, 2, ["lang"])
    assert found.groupBy("lang").count().where("count = 3").count() == 2


@pytest.fixture(scope="module")
def labelled(spark):
    """Label a holds a third of the rows, label z belongs to no subset."""
    rows = spark.range(300).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.element_at(F.array(*map(F.lit, "bcdz")), (F.col("id") % 4 + 1).cast("int"))).alias("label")
    )
    mapping = spark.createDataFrame([("s0", 0, "a"), ("s0", 1, "b"), ("s1", 0, "c"), ("s1", 1, "d")], "subset_id string, pos long, label string")
    return rows, mapping


@pytest.mark.parametrize("cap", [5, 20, 1000])
def test_noise_candidates_equal_the_plain_form(labelled, cap):
    import hashlib

    rows, mapping = labelled
    homes = {"a": "s0", "b": "s0", "c": "s1", "d": "s1"}
    everything = [(r["row_id"], r["label"]) for r in rows.collect()]
    found = {}
    for r in maps.noise_candidates(rows, mapping, cap).collect():
        found.setdefault(r["subset_id"], []).append((r["place"], r["row_id"]))
    for subset in ("s0", "s1"):
        outside = [i for i, label in everything if homes.get(label) != subset]
        wanted = sorted(outside, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:cap]
        assert [i for _, i in sorted(found[subset])] == wanted


@pytest.mark.parametrize("target", [0, 3, 10, 25])
def test_oversampling_cycles_through_the_candidates(spark, target):
    candidates = spark.createDataFrame([("s", i, p + 1) for p, i in enumerate([30, 10, 20, 40])], "subset_id string, row_id long, place int")
    targets = spark.createDataFrame([("s", target)], "subset_id string, target long")
    found = sorted(r["row_id"] for r in maps.oversample_noise(candidates, targets).collect())
    assert found == sorted(([30, 10, 20, 40] * 7)[:target])


def test_training_rows_are_own_rows_and_outside_noise(labelled):
    rows, mapping = labelled
    found = maps.training_with_noise(rows, mapping, 2.0)
    own = found.where(F.col("label") != NOISE_LABEL)
    assert own.count() == rows.where("label <> 'z'").count()
    noise = found.where(F.col("label") == NOISE_LABEL).join(rows.withColumnRenamed("label", "home"), "row_id")
    assert noise.where("subset_id = 's0' AND home IN ('a', 'b')").isEmpty()
    targets = {r["subset_id"]: r["target"] for r in maps.noise_targets(rows, mapping).collect()}
    counts = {r["subset_id"]: r["count"] for r in noise.groupBy("subset_id").count().collect()}
    assert counts == {s: min(t, 10**6) for s, t in targets.items()}


def test_first_match_wins_seed_before_validated(spark):
    labelled = spark.createDataFrame(
        [(1, 9, "t", "late"), (0, 5, "t", "second"), (0, 4, "t", "first"), (1, 1, "u", "only")],
        "src int, row_id long, text string, label string",
    )
    queries = spark.createDataFrame([(1, "t"), (2, "u"), (3, "v")], "row_id long, text string")
    for hot in (1, 10**6):
        found = {r["row_id"]: r["label"] for r in maps.label_by_text(queries, labelled, hot).collect()}
        assert found == {1: "first", 2: "only", 3: None}


def test_fixed_mapping_numbers_labels_in_ranges(spark):
    labels = spark.createDataFrame([(f"c{i * 7 % 300}",) for i in range(600)] + [(None,)], "label string").repartition(5)
    found = maps.fixed_mapping(labels, 8)
    wanted = [None, *sorted({f"c{i}" for i in range(300)})]
    assert {(r.subset_id, r.pos, r.label) for r in found.collect()} == {(f"subset_{i // 8}", i % 8, x) for i, x in enumerate(wanted)}
    # The one window over all rows is that over the counts of the ranges.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(label" not in plan
