import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tagmill.constants import NOISE_LABEL
from tagmill.operators import balance, evaluate, features, judge, linear, models, progress, sparse
from tagmill.operators.mapping import attach_subset
from tagmill.options import Options
from tagmill.plans import active, experiment, initial, training
from tagmill.sources import files, state
from tagmill.storage import settle, fresh_path
from tagmill.streaming import arrivals


@pytest.fixture(scope="module")
def clusters(spark):
    """Four separable classes in two subsets; one class holds most rows."""
    rng = np.random.default_rng(3)
    rows = []
    for c, n in enumerate((60, 15, 20, 12)):
        center = np.eye(4)[c] * 6
        rows += [(f"c{c}", [float(x) for x in center + rng.normal(size=4)]) for _ in range(n)]
    frame = spark.createDataFrame([(i, label, v) for i, (label, v) in enumerate(rows)], "row_id long, label string, vector array<double>")
    mapping = spark.createDataFrame([("s0", 0, "c0"), ("s0", 1, "c1"), ("s1", 0, "c2"), ("s1", 1, "c3")], "subset_id string, pos long, label string")
    return frame, mapping


def test_smote_raises_every_class_and_stays_between_neighbours(clusters):
    frame, mapping = clusters
    rows = attach_subset(frame, mapping)
    made = balance.smote(rows).collect()
    counts = {}
    for r in made:
        counts[(r["subset_id"], r["label"])] = counts.get((r["subset_id"], r["label"]), 0) + 1
    assert counts == {("s0", "c1"): 45, ("s1", "c3"): 8}
    box = {}
    for r in rows.collect():
        box.setdefault(r["label"], []).append(r["vector"])
    for r in made:
        low, high = np.min(box[r["label"]], axis=0), np.max(box[r["label"]], axis=0)
        assert np.all(low - 1e-9 <= r["vector"]) and np.all(r["vector"] <= high + 1e-9)
    assert [tuple(r["vector"]) for r in balance.smote(rows.repartition(7)).orderBy("label", "row_id", "copy").collect()] == [
        tuple(r["vector"]) for r in balance.smote(rows).orderBy("label", "row_id", "copy").collect()
    ]


def test_smote_is_skipped_as_a_whole(spark, clusters):
    frame, mapping = clusters
    rows = attach_subset(frame, mapping)
    tiny = rows.where("label <> 'c3' OR row_id >= 102")  # five rows: too few neighbours
    assert balance.smote(tiny).where("subset_id = 's1'").isEmpty()
    one_class = rows.where("label IN ('c0', 'c2', 'c3')")
    assert balance.smote(one_class).where("subset_id = 's0'").isEmpty()


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest"])
def test_fitted_models_separate_the_classes(spark, clusters, kind):
    frame, mapping = clusters
    options = Options(classifier=kind, max_iter=50, noise_factor=1.0)
    found = training.train_subsets(frame, mapping, options)
    stats = {r["subset_id"]: r for r in found.stats.collect()}
    assert all(r["train_accuracy"] > 0.9 for r in stats.values()) and found.failed == 0
    assert {r["label"] for r in found.distribution.where("n > 0").collect()} == {"c0", "c1", "c2", "c3", NOISE_LABEL}
    scored = training.score(frame, found.models, found.weights)
    assert scored.count() == 2 * frame.count()
    routed = evaluate.route_by_score(scored).join(frame, "row_id")
    assert routed.where("label = predicted_label").count() > 0.9 * frame.count()
    sums = scored.select(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s"), "uncertainty", F.size("labels").alias("c"))
    assert sums.where("abs(s - 1) > 1e-9 OR uncertainty < 0 OR uncertainty > log2(c) + 1e-9").isEmpty()


def test_linear_scores_equal_the_fitted_models_in_any_number_of_passes(spark, clusters):
    frame, mapping = clusters
    table = models.training_features(attach_subset(frame, mapping), mapping)
    fitted, log = models.fit_subsets(table, max_iter=30)
    weights = models.coefficient_table(spark, fitted)
    plain = models.score_models(frame.withColumn("features", array_to_vector("vector")), fitted)
    wanted = {(r["row_id"], r["subset_id"]): r for r in plain.collect()}
    for size in (1, 10**9):
        found = models.score_linear(frame, weights, pass_bytes=size).collect()
        assert len(found) == len(wanted)
        for r in found:
            other = wanted[(r["row_id"], r["subset_id"])]
            assert r["predicted_label"] == other["predicted_label"] and r["uncertainty"] == pytest.approx(other["uncertainty"], abs=1e-9)


def test_a_failing_subset_does_not_stop_the_others(spark, clusters):
    frame, mapping = clusters
    rows = attach_subset(frame.where("label <> 'c3'"), mapping)
    fitted, log = models.fit_subsets(models.training_features(rows, mapping), max_iter=10)
    errors = {r["subset_id"]: r["error"] for r in log.collect()}
    assert list(fitted) == ["s0"] and errors["s0"] is None and "two classes" in errors["s1"]
    summary = {r["subset_id"]: r["is_trained"] for r in models.training_summary(log, mapping, "logistic_regression").collect()}
    assert summary == {"s0": True, "s1": False}


def test_forest_models_survive_saving(spark, clusters):
    frame, mapping = clusters
    table = models.training_features(attach_subset(frame, mapping), mapping)
    fitted, _ = models.fit_subsets(table, "random_forest")
    path = fresh_path(spark, "models")
    state.save_models(spark, fitted, path, "random_forest")
    loaded, weights = state.load_models(spark, path)
    assert weights is None

    def labels(m):
        return {(r["row_id"], r["subset_id"]): r["predicted_label"] for r in models.score_models(table, m).collect()}

    assert labels(fitted) == labels(loaded)
    # One scan for all subsets, or one each, gives what MLlib's own transform gives.
    wanted = {}
    for subset_id, (model, _) in fitted.items():
        for r in model.transform(table).select("row_id", "probability").collect():
            wanted[r["row_id"], subset_id] = r["probability"].toArray()
    homes = {r["row_id"]: r["subset_id"] for r in table.collect()}
    for group in (1, 32):
        found = {(r["row_id"], r["subset_id"]): r["probabilities"] for r in models.score_models(table, loaded, group=group).collect()}
        assert found.keys() == wanted.keys() and all(np.array_equal(found[k], wanted[k]) for k in wanted)
        own = {(r["row_id"], r["subset_id"]): r["probabilities"] for r in models.score_models(table, loaded, own=True, group=group).collect()}
        assert own == {k: p for k, p in found.items() if homes[k[0]] == k[1]}


def test_terms_are_counted_alike_in_pieces_of_any_size(spark, monkeypatch):
    texts = ["the of with because because cats", "cats because", None, "", "x", "Cats because with dogs dogs dogs", "dogs " * 40]
    rows = spark.createDataFrame([(i, t, "ab"[i % 2] if i else None) for i, t in enumerate(texts * 2)], "row_id long, text string, part string").coalesce(1)
    wanted = {}
    for i, text in enumerate(texts * 2):
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w not in ("the", "of", "with")]
        for term in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}:
            n = words.count(term) + [f"{a} {b}" for a, b in zip(words, words[1:])].count(term)
            old = wanted.get(("ab"[i % 2] if i else None, term), (0, 0))
            wanted["ab"[i % 2] if i else None, term] = (old[0] + n, old[1] + 1)
    # the two queries over all documents count such words too, as they did before their stop words grew
    from suite import texts as queries

    assert "because" not in queries.STOP_WORDS and "'because'" not in queries.FEW_STOPS
    for size in (3, 10**6):
        monkeypatch.setattr(features, "WORDS", size)
        found = features.term_totals(rows, ("the", "of", "with"), ["part"]).collect()
        assert {(r["part"], r["term"]): (r["tf"], r["df"]) for r in found} == wanted and len(found) == len(wanted)
        counts = features.term_counts(rows, ["dogs", "dogs dogs", "cats because", "none such"], (), ["row_id"]).where("row_id >= 5")
        assert {(r["row_id"], r["term"]): r["n"] for r in counts.collect()} == {
            (5, "dogs"): 3, (5, "dogs dogs"): 2, (5, "cats because"): 1, (6, "dogs"): 40, (6, "dogs dogs"): 39, (8, "cats because"): 1,
            (12, "dogs"): 3, (12, "dogs dogs"): 2, (12, "cats because"): 1, (13, "dogs"): 40, (13, "dogs dogs"): 39,
        }


def test_a_large_table_arrives_in_more_files(spark, tmp_path, monkeypatch):
    from suite import learning

    frame = spark.range(1000).withColumnRenamed("id", "row_id")
    frame.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert learning.arriving_files(table) == 4
    monkeypatch.setattr(learning, "FILE_BYTES", 500)
    assert learning.arriving_files(table) > 8 and learning.arriving_files(table) % 2 == 0


def test_tfidf_vectors_equal_the_long_form(spark):
    texts = ["red apple red", "green apple pear", "pear pear tree", "", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    vocab = features.vocabulary(rows, 6)
    wide = {r["row_id"]: r["features"] for r in features.tfidf_vectors(rows, vocab).collect()}
    long = features.tfidf(rows, vocab).collect()
    assert len(long) == sum(v.numNonzeros() for v in wide.values())
    for r in long:
        assert wide[r["row_id"]][r["idx"]] == pytest.approx(r["weight"])
    plain = {r["term"]: (r["tf"], r["df"]) for r in vocab.collect()}
    assert plain["red"] == (2, 1) and plain["apple"] == (2, 2) and plain["pear"] == (3, 2)


def test_training_on_tfidf_features(spark):
    rows = spark.createDataFrame(
        [(i, "cat purr meow" if i % 2 else "dog bark woof", "cat" if i % 2 else "dog") for i in range(30)], "row_id long, text string, label string"
    )
    mapping = spark.createDataFrame([("s", 0, "cat"), ("s", 1, "dog")], "subset_id string, pos long, label string")
    vocab = features.vocabulary(rows, 100, ["woof"])
    wide = features.tfidf_vectors(rows, vocab, ["woof"]).join(mapping, "label").withColumn("class_idx", F.col("pos").cast("int"))
    fitted, _ = models.fit_subsets(wide, max_iter=20)
    assert models.score_models(wide, fitted, keep=("row_id", "label")).where("label <> predicted_label").isEmpty()


def themed(spark, sizes, seed=5):
    """Texts of classes with words of their own; some have no known word or no text at all."""
    draw = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(sizes):
        for _ in range(n):
            words = [f"word{c}x{draw.integers(6)}" for _ in range(4)] + [f"shared{draw.integers(30)}" for _ in range(5)] + ["the", "and"]
            rows.append((len(rows), " ".join(draw.permutation(words)), f"c{c}"))
    rows += [(len(rows), "", "c0"), (len(rows) + 1, None, "c1"), (len(rows) + 2, "the of", "c2")]
    frame = spark.createDataFrame(rows, "row_id long, text string, label string")
    mapping = spark.createDataFrame([(f"s{c // 2}", c % 2, f"c{c}") for c in range(len(sizes))], "subset_id string, pos long, label string")
    return frame, mapping


def test_sparse_features_and_scores_equal_the_dense_ones(spark):
    frame, mapping = themed(spark, (12, 9, 14, 10))
    rows = attach_subset(frame, mapping)
    vocab = sparse.subset_vocabulary(rows, 50)
    sizes = {r["subset_id"]: r["n"] for r in vocab.groupBy("subset_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"s0": 50, "s1": 50} and vocab.where("term IN ('the', 'and', 'of')").isEmpty()
    dense = {}
    for subset in sizes:
        wide = features.tfidf_vectors(frame.na.fill("", ["text"]), vocab.where(F.col("subset_id") == subset))
        dense |= {(r["row_id"], subset): r["features"].toArray() for r in wide.collect()}
    found = {}
    for size in (1, 10**9):
        for r in sparse.sparse_features(frame, vocab, ("row_id", "label"), own=False, pass_bytes=size).collect():
            found[r["row_id"], r["subset_id"]] = np.zeros(50)
            found[r["row_id"], r["subset_id"]][r["indices"]] = r["values"]
        assert found.keys() == dense.keys()
        for key, value in dense.items():
            assert found[key] == pytest.approx(value, abs=1e-12)
    given = sparse.sparse_features(rows, vocab, ("row_id", "label"))
    assert {(r["row_id"], r["subset_id"]) for r in given.collect()} == {(r["row_id"], r["subset_id"]) for r in rows.collect()}
    weights, log = linear.fit_linear(given.join(mapping, ["subset_id", "label"]).withColumn("class_idx", F.col("pos").cast("int")))
    assert log.where("error IS NOT NULL").isEmpty()
    table = {(r["subset_id"], r["label"]): (np.array(r["coefficients"]), r["intercept"]) for r in weights.collect()}
    for size in (1, 10**9):
        for r in sparse.score_sparse(frame, vocab, weights, pass_bytes=size).collect():
            raw = np.array([table[r["subset_id"], c][0] @ dense[r["row_id"], r["subset_id"]][: len(table[r["subset_id"], c][0])] + table[r["subset_id"], c][1] for c in r["labels"]])
            share = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
            assert r["probabilities"] == pytest.approx(share, abs=1e-9) and r["max_probability"] == pytest.approx(share.max())
    assert sparse.score_sparse(frame.limit(0), vocab, weights).count() == 0


def test_sparse_smote_equals_the_dense_one(spark):
    frame, mapping = themed(spark, (30, 12, 25, 9))
    rows = attach_subset(frame.where("text LIKE '%word%'"), mapping)
    vocab = sparse.subset_vocabulary(rows, 60)
    given = sparse.sparse_features(rows, vocab, ("row_id", "label"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.coalesce(F.get("values", F.array_position("indices", i).cast("int") - 1), F.lit(0.0)))
    plain = balance.smote(given.withColumn("vector", F.when(F.lit(True), wide)).drop("indices", "values"))
    wanted = {(r["subset_id"], r["label"], r["row_id"], r["copy"]): r["vector"] for r in plain.collect()}
    made = balance.smote(given).collect()
    assert len(made) == len(wanted) == 34
    for r in made:
        line = np.zeros(60)
        line[r["indices"]] = r["values"]
        assert line == pytest.approx(wanted[r["subset_id"], r["label"], r["row_id"], r["copy"]], abs=1e-9)


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest"])
def test_training_on_tfidf(spark, kind):
    frame, mapping = themed(spark, (40, 26, 33, 28))
    options = Options(classifier=kind, features="tfidf", max_features=200, max_depth=8, use_smote=kind == "logistic_regression")
    found = training.train_subsets(frame, mapping, options)
    assert found.failed == 0 and found.fitted == ("s0", "s1")
    assert all(r["train_accuracy"] > 0.7 for r in found.stats.collect())
    scored = training.score(frame, found.models, found.weights, found.vocabulary, options)
    routed = evaluate.route_by_score(scored).join(frame, "row_id")
    assert scored.count() == 2 * frame.count() and routed.where("label = predicted_label").count() > 0.7 * frame.count()


def test_both_runs_on_tfidf(spark):
    options = Options(subset_size=2, batch_size=25, max_iterations=1, retrain_threshold=5, noise_factor=1.0, use_smote=False, features="tfidf", max_features=40)
    encoder, run_dir, loop_dir = features.word_hash_encoder(16), fresh_path(spark, "run"), fresh_path(spark, "loop")
    initial.run_initial(spark, corpus(spark, 60), run_dir, encoder, None, options)
    parts = initial.load_components(spark, run_dir)
    assert parts.vocabulary.select("subset_id").distinct().count() == 2 and parts.weights.count() == 6
    found = active.run_active(spark, run_dir, corpus(spark, 50, start=1000).drop("label"), loop_dir, encoder, make_judge(), options)
    assert found.validated.count() > 0 and found.history.agg(F.max("retrained_classifiers")).first()[0] > 0
    tables, _ = active.load_final(spark, loop_dir)
    vocab = state.load_vocabulary(spark, tables["models"].first()["path"])
    assert vocab.groupBy("subset_id", "idx").count().where("count > 1").isEmpty() and vocab.select("subset_id").distinct().count() == 2


def test_vocabulary_per_subset(spark):
    rows = spark.createDataFrame([("a", "xx yy"), ("a", "xx"), ("b", "yy zz zz")], "subset_id string, text string")
    found = features.vocabulary(rows, 1, by=["subset_id"])
    assert {(r["subset_id"], r["term"], r["tf"], r["df"]) for r in found.collect()} == {("a", "xx", 2, 2), ("b", "zz", 2, 1)}


def test_terms_of_a_group_are_ranked_in_parts(spark, monkeypatch):
    draw = np.random.default_rng(3)
    lines = [(s, " ".join(f"w{int(x)}" for x in draw.zipf(1.6, 30) if x < 10**6)) for s in "ab" for _ in range(40)]
    rows = settle(spark.createDataFrame(lines + [("b", None)], "subset_id string, text string"), "rows")
    totals = features.term_totals(rows, by=["subset_id"]).collect()
    monkeypatch.setattr(features, "RANKED_BYTES", 100)
    found = {(r["subset_id"], r["term"]): (r["idx"], r["tf"], r["df"]) for r in features.vocabulary(rows, 50, by=["subset_id"]).collect()}
    wanted = {}
    for s in "ab":
        best = sorted((-r["tf"], r["term"], r["df"]) for r in totals if r["subset_id"] == s)[:50]
        wanted |= {(s, term): (at, -tf, df) for at, (tf, term, df) in enumerate(best)}
    assert found == wanted
    part = features.best_of_parts(spark.createDataFrame(totals), ["subset_id"], [F.desc("tf"), "term"], 5, 7)
    assert 5 < part.where("subset_id = 'a'").count() <= 35


def test_encoder_runs_once_per_new_text(spark, tmp_path):
    calls = tmp_path / "calls"

    def encoder(texts):
        import numpy as np

        with open(calls, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return np.ones((len(texts), 2))

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "row_id long, text string")
    first, fresh = features.embed_texts(rows, spark.createDataFrame([], features.EMPTY_CACHE), encoder, "m")
    assert first.count() == 3 and fresh.count() == 2
    more = rows.unionByName(spark.createDataFrame([(4, "c")], "row_id long, text string"))
    again, fresh2 = features.embed_texts(more, fresh, encoder, "m", strict=True)
    assert again.count() == 4 and fresh2.count() == 1
    assert sorted(calls.read_text().split()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        features.embed_texts(spark.createDataFrame([(1, " ")], "row_id long, text string"), fresh, encoder, "m", strict=True)


def make_judge():
    """Answers by digest; a closure, so that workers need no test module."""

    def answer(prompts):
        return ["True" if hashlib.md5(p.encode()).hexdigest() < "9" else "False" for p in prompts]

    return answer


def rows_to_judge(spark):
    return spark.createDataFrame(
        [(i, f"t{i % 4}", "a" if i % 2 else "b", [1.0, float(i % 4)]) for i in range(12)], "row_id long, text string, predicted_label string, vector array<double>"
    )


def test_judge_asks_each_pair_once_and_uses_the_cache(spark, tmp_path):
    asked = tmp_path / "asked"

    def counting(prompts):
        with open(asked, "a") as out:
            out.write("x\n" * len(prompts))
        return ["True"] * len(prompts)

    labelled = rows_to_judge(spark).withColumnRenamed("predicted_label", "label")
    none = spark.createDataFrame([], "label string, description string")
    empty = spark.createDataFrame([], judge.CACHE_SCHEMA)
    for hot in (1, 10**6):
        asked.write_text("")
        results, fresh = judge.judge_batch(rows_to_judge(spark), empty, labelled, none, counting, 2, hot_rows=hot)
        assert results.count() == 12 and fresh.count() == 4 and asked.read_text().count("x") == 4
        assert results.where("is_valid AND confidence = 0.8 AND NOT cached AND n_examples = 2").count() == 12
    again, fresh2 = judge.judge_batch(rows_to_judge(spark), fresh, labelled, none, counting, 2)
    assert again.where("cached").count() == 12 and fresh2.isEmpty() and asked.read_text().count("x") == 4


def test_examples_are_shared_within_a_task(spark, monkeypatch):
    """A text travels once per task that needs it, however many rows have it as an example, and the prompts are not shuffled."""
    rows = [(i, "t", None if i % 10 == 9 else f"l{i % 3}", [1.0, float(i)]) for i in range(300)] + [(None, "t", "l0", [1.0, 0.0])]
    asked = spark.createDataFrame(rows, "query_id long, text string, predicted_label string, vector array<double>")
    known = [(i, f"l{i % 3}", None if i == 6 else f"x{i}", [1.0, i * 10.0]) for i in range(12)] + [(3, "l0", "a twin", [1.0, 30.0])]
    labelled = spark.createDataFrame(known, "row_id long, label string, text string, vector array<double>")
    found = {r["query_id"]: r["examples"] for r in judge.with_examples(asked, labelled, 4).collect()}
    assert len(found) == 301 and found[None] == [] and found[9] == []
    unit = {(i, text): np.array(v) / np.linalg.norm(v) for i, _, text, v in known}
    for i, _, label, v in rows[:300]:
        if label is None:
            continue
        own = [(round(float(np.array(v) / np.linalg.norm(v) @ unit[j, text]), 9), j) for j, known_label, text, _ in known if known_label == label]
        near = sorted(own, key=lambda p: (-p[0], p[1]))[:4]
        texts = [t for _, j in near for t in sorted((t for n, _, t, _ in known if n == j), key=lambda t: (t is not None, t))]
        assert found[i] == texts, i
    none = spark.createDataFrame([], "label string, description string")
    plan = judge.validation_prompts(asked, labelled, none, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition")  # the texts meet the rows after the last shuffle
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_examples_come_in_passes_of_bounded_size(spark, monkeypatch, tmp_path):
    asked = tmp_path / "asked"

    def answer(prompts):
        with open(asked, "a") as out:
            out.write("x\n" * len(prompts))
        return [hashlib.md5(p.encode()).hexdigest() for p in prompts]

    rows = spark.createDataFrame(
        [(i, f"t{i}", f"l{i % 3}", [1.0, float(i)]) for i in range(40)], "row_id long, text string, predicted_label string, vector array<double>"
    )
    labelled = spark.createDataFrame([(i, f"l{i % 3}", f"x{i}", [1.0, i * 10.0]) for i in range(12)], "row_id long, label string, text string, vector array<double>")
    none = spark.createDataFrame([], "label string, description string")
    replies = lambda: sorted((r.row_id, r.reply) for r in judge.judge_batch(rows, spark.createDataFrame([], judge.CACHE_SCHEMA), labelled, none, answer, 2)[0].collect())
    whole, ask, passes = replies(), judge.ask, []
    dealt = judge.dealt_by_label
    monkeypatch.setattr(judge, "dealt_by_label", lambda rows: dealt(rows, 5))
    monkeypatch.setattr(judge, "PASS_CELLS", 3)
    monkeypatch.setattr(judge, "ask", lambda *given: passes.append(1) or ask(*given))
    assert replies() == whole and len(passes) == 3 and asked.read_text().count("x") == 80


def test_tables_of_a_training_go_when_it_ends(spark, clusters):
    import glob

    from tagmill.storage import work_dir

    left = lambda: {p for name in ("training", "unbalanced", "minority") for p in glob.glob(f"{work_dir(spark)}/{name}-*")}
    before = left()
    found = training.train_subsets(*clusters, Options())
    assert left() == before
    assert found.weights.count() > 0 and found.log.where("error IS NULL").count() == 2 and found.report.count() > 0


def test_failed_requests_are_not_cached(spark):
    def broken(prompts):
        raise RuntimeError("no connection")

    labelled = rows_to_judge(spark).withColumnRenamed("predicted_label", "label").where("false")
    none = spark.createDataFrame([], "label string, description string")
    results, fresh = judge.judge_batch(rows_to_judge(spark), spark.createDataFrame([], judge.CACHE_SCHEMA), labelled, none, broken)
    assert fresh.isEmpty()
    assert results.where("error = 'no connection' AND NOT is_valid AND confidence = 0.0 AND n_examples = 0").count() == 12
    counts = judge.validation_summary(results).first()
    assert counts["request_errors"] == 12 and counts["error_rate"] == 1.0 and counts["cache_hits"] == 0


def history(spark, rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "iteration int, predictions_made long, validated_samples long, validation_rate double")


def test_stopping(spark):
    rows = history(spark, [(5, 3, 0.6), (0, 0, 0.0), (4, 2, 0.5), (0, 0, 0.0), (3, 1, 0.3)])
    first = progress.stop_points(rows).orderBy("iteration").collect()
    assert [r["stops"] for r in first] == [False, True, False, False, False]
    later = progress.stop_points(rows, mode="informative_then_all_predicted", all_predicted=3).orderBy("iteration").collect()
    assert [r["stops"] for r in later] == [False, False, False, True, False]
    assert [r["phase"] for r in later] == ["informative", "informative", "all_predicted", "all_predicted", "all_predicted"]
    assert [r["empty_count"] for r in later] == [0, 1, 2, 3, 4]


def test_convergence_and_retraining(spark):
    rows = history(spark, [(9, 2, 0.005), (9, 1, 0.005), (9, 1, 0.005), (9, 0, 0.5), (9, 98, 0.9), (9, 120, 0.9)])
    assert [r["converged"] for r in progress.converged(rows).orderBy("iteration").collect()] == [False, False, True, True, False, False]
    due = progress.retrain_due(rows, threshold=100).orderBy("iteration").collect()
    assert [r["due"] for r in due] == [False, False, False, False, True, True]
    assert [r["cumulative_validated"] for r in due] == [2, 3, 4, 4, 102, 222]


TEXTS = {"cat": "cat purr meow whisker", "dog": "dog bark woof leash", "sun": "sun light warm sky", "rain": "rain cloud wet storm"}


def corpus(spark, n, start=0):
    names = sorted(TEXTS)
    rows = [(i, f"{TEXTS[names[i % 4]]} number{i} word{i % 7}", names[i % 4]) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "row_id long, text string, label string")


def test_both_runs_and_resuming(spark):
    options = Options(subset_size=2, max_iter=30, batch_size=20, samples_per_iteration=30, max_iterations=1, retrain_threshold=10, noise_factor=1.0, use_smote=False)
    encoder = features.word_hash_encoder(16)
    run_dir, loop_dir = fresh_path(spark, "run"), fresh_path(spark, "loop")
    parts = initial.run_initial(spark, corpus(spark, 80), run_dir, encoder, None, options)
    assert parts.mapping.count() == 4 and parts.trained.failed == 0
    pool = corpus(spark, 50, start=1000).drop("label")
    first = active.run_active(spark, run_dir, pool, loop_dir, encoder, make_judge(), options)
    seen = first.history.orderBy("iteration").collect()
    assert [r["iteration"] for r in seen] == [1] and first.stopped == "out of iterations"
    assert all(r["informative_samples"] <= min(30, r["predictions_made"]) for r in seen)
    assert sum(r["validated_samples"] for r in seen) == first.validated.count() == seen[-1]["cumulative_validated"]
    judged = first.verdicts
    assert judged.where("is_valid").count() == first.validated.count()
    assert first.validated.join(judged, ["row_id"], "left_anti").isEmpty()
    assert first.fits.where("iteration > 0 AND retrained").count() >= 2
    tables, (_, weights) = active.load_final(spark, loop_dir)
    assert tables["training"].count() == 80 + first.validated.count() and weights.count() == 6
    assert tables["verdicts"].count() == state.read_appended(spark, loop_dir, "verdicts", judge.CACHE_SCHEMA).count()

    more = active.run_active(spark, run_dir, pool, loop_dir, encoder, make_judge(), replace(options, max_iterations=9, retrain_threshold=1000))
    seen = more.history.orderBy("iteration").collect()
    assert [r["iteration"] for r in seen][:3] == [1, 2, 3] and more.stopped in ("pool exhausted", "converged", "informative_only")
    assert sum(r["batch_size"] for r in seen) == 50
    summary = more.performance.first()
    assert summary["total_iterations"] == len(seen)


def test_a_loop_with_a_stored_index_judges_like_one_without(spark):
    options = Options(subset_size=2, max_iter=30, batch_size=30, max_iterations=1, retrain_threshold=1000, noise_factor=1.0, use_smote=False, keep_examples=True)
    encoder = features.word_hash_encoder(16)
    run_dir = fresh_path(spark, "run")
    initial.run_initial(spark, corpus(spark, 60), run_dir, encoder, None, options)
    pool = corpus(spark, 30, start=1000).drop("label")
    seen = []
    for stored in (False, True):
        loop_dir = fresh_path(spark, "loop")
        found = active.run_active(spark, run_dir, pool, loop_dir, encoder, make_judge(), replace(options, example_index=stored))
        verdicts = state.read_appended(spark, loop_dir, "verdicts", f"{judge.CACHE_SCHEMA}, {judge.EXAMPLES}")
        examples = {(r["text_md5"], r["predicted_label"]): r["examples"] for r in verdicts.collect()}
        log = sorted((r["row_id"], r["predicted_label"], r["is_valid"], r["confidence"]) for r in found.verdicts.collect())
        seen.append((log, examples))
        assert state.exists(spark, f"{loop_dir}/examples/settings/_SUCCESS") == stored
    assert seen[0] == seen[1] and seen[0][1]


def test_one_and_two_iterations_equal_three(spark):
    options = Options(subset_size=2, max_iter=30, batch_size=15, max_iterations=3, retrain_threshold=5, noise_factor=1.0, use_smote=False)
    encoder = features.word_hash_encoder(16)
    run_dir = fresh_path(spark, "run")
    initial.run_initial(spark, corpus(spark, 40), run_dir, encoder, None, options)
    pool = corpus(spark, 60, start=1000).drop("label")
    whole = active.run_active(spark, run_dir, pool, fresh_path(spark, "loop"), encoder, make_judge(), options)
    loop_dir = fresh_path(spark, "loop")
    active.run_active(spark, run_dir, pool, loop_dir, encoder, make_judge(), replace(options, max_iterations=1))
    parts = active.run_active(spark, run_dir, pool, loop_dir, encoder, make_judge(), options)

    def rows(frame, *dropped):
        return sorted(map(str, frame.drop("iteration_time", *dropped).collect()))

    assert rows(whole.history) == rows(parts.history) and whole.history.agg(F.max("retrained_classifiers")).first()[0] > 0
    assert rows(whole.verdicts) == rows(parts.verdicts)
    assert rows(whole.fits) == rows(parts.fits)
    found = []
    for folder in (whole.run_dir, loop_dir):
        path = state.load_state(spark, folder)[1]["models"].first()["path"]
        vectors = state.load_state(spark, run_dir, 0)[1]["labelled"].select("row_id", "vector")
        found.append(rows(training.score(vectors, *state.load_models(spark, path)).select("row_id", "subset_id", "predicted_label")))
    assert found[0] == found[1]


def test_experiment_table(spark):
    options = Options(subset_size=4, max_iter=20, batch_size=30, samples_per_iteration=10, max_iterations=1, use_smote=False)
    found = experiment.run_experiments(
        spark, corpus(spark, 100), fresh_path(spark, "exp"), features.word_hash_encoder(16), make_judge(), options, sizes=(16,)
    ).collect()
    assert [(r["samples_per_class"], r["support"], r["iterations"]) for r in found] == [(16, 36, 1)]
    assert found[0]["accuracy"] > 0.8


def test_stream_scores_every_arrival(spark, clusters):
    frame, mapping = clusters
    fitted, _ = models.fit_subsets(models.training_features(attach_subset(frame, mapping), mapping), max_iter=20)
    weights = models.coefficient_table(spark, fitted)
    path, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    source = frame.select("row_id", "vector").repartition(3)
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    arrivals.stream_score(stream, lambda batch: batch, weights, out, 5)
    queue = state.read_appended(spark, out, "queue", "row_id long, subset_id string, predicted_label string, uncertainty double")
    assert queue.count() == 15 and queue.select("iteration").distinct().count() == 3
    scored = state.read_appended(spark, out, "predictions", "row_id long, subset_id string, predicted_label string")
    assert scored.select("row_id").distinct().count() == frame.count()


def test_files_round_trip(spark):
    rows = spark.createDataFrame([(1, ' a,"b"\nc ', "x y"), (2, "é\t", 'q"')], "row_id long, text string, label string")
    for format in ("csv", "json", "parquet"):
        path = fresh_path(spark, format)
        files.write_rows(rows.select("text", "label"), path, format)
        multi = lambda s, p: files.read_csv(s, p, columns=["text", "label"], multi_line=True)
        reader = {"csv": multi, "json": files.read_json}.get(format, lambda s, p: s.read.parquet(p))
        assert sorted(map(tuple, reader(spark, path).collect())) == sorted((r["text"], r["label"]) for r in rows.collect())
    with pytest.raises(ValueError):
        files.write_rows(rows, "x", "excel")
    path = fresh_path(spark, "pool")
    spark.createDataFrame([('{"text": "a"}',), ('"b {x}"',), ('{"text": ""}',)], "value string").write.text(path)
    assert sorted(r[0] for r in files.read_pool_json(spark, path).collect()) == ["", "a", "b {x}"]


def test_state_ignores_incomplete_iterations(spark):
    run_dir = fresh_path(spark, "run")
    assert state.latest_iteration(spark, run_dir) is None
    with pytest.raises(FileNotFoundError):
        state.load_state(spark, run_dir)
    state.save_state(run_dir, 1, rows=spark.range(3))
    spark.range(9).write.parquet(f"{run_dir}/state/iter=2/rows")  # no manifest yet
    at, tables = state.load_state(spark, run_dir)
    assert at == 1 and tables["rows"].count() == 3
