"""Classifiers, balancing, the judge, the loop and arriving texts."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from suite.fixtures import (
    BASE, DOCS, EMB, HISTORY, MAPPING, PARTS, PART_MAPPING, RUNS, SCORED, SEED, documents, history, linear_models, mapping, part_mapping,
    parts, pool, seed, settle, vector_mapping, vectors,
)
from suite.registry import query
from suite.relational import verdict_cache, verdict_rows
from suite.texts import DESCRIBE, STOP_SQL, chat_sql, filled
from tagmill import constants as K
from tagmill.functions import prompts
from tagmill.operators import balance, cleaning, features, judge, linear, mapping as maps, models, progress, refined, sparse
from tagmill.options import Options
from tagmill.plans import active, initial, training
from tagmill.sources import state
from tagmill.storage import estimated_bytes, fresh_path, lookup_join
from tagmill.streaming import arrivals


# classifiers


def training_table(spark, sf):
    """Vectors with their subset and class number."""
    rows = maps.attach_subset(vectors(spark, sf), vector_mapping(spark, sf))
    return models.training_features(rows, vector_mapping(spark, sf))


VECTOR_MAPPING = """mapping AS (SELECT 'subset_' || ((row_number() OVER (ORDER BY label) - 1) // 4) AS subset_id, label
FROM (SELECT DISTINCT 'c' || label AS label FROM embeddings))"""


@query(f"""WITH {VECTOR_MAPPING}, own AS (SELECT subset_id, count(*) AS rows FROM (SELECT 'c' || label AS label FROM embeddings)
JOIN mapping USING (label) GROUP BY subset_id) SELECT subset_id, label, rows, true AS at_optimum FROM own JOIN mapping USING (subset_id)""")
def train_logreg(spark, sf):
    """Whether the penalised likelihood is flat at the fitted weights, from data and weights."""
    rows = training_table(spark, sf)
    weights, _ = linear.fit_linear(rows)
    scored = settle(models.score_linear(rows, weights, keep=("row_id", "label", "vector"), own=True), "scored")
    each = scored.select("subset_id", F.col("label").alias("true_label"), "vector", F.inline(F.arrays_zip(F.col("labels").alias("label"), F.col("probabilities").alias("p"))))
    error = F.col("p") - (F.col("true_label") == F.col("label")).cast("double")
    parts_ = each.select("subset_id", "label", error.alias("error"), F.posexplode(F.concat("vector", F.array(F.lit(1.0)))).alias("pos", "x"))
    return at_optimum(parts_, weights)


def at_optimum(parts_, weights):
    """Whether the slopes vanish, from ``subset_id, label, error, pos, x`` (the intercept stands last, without a penalty)."""
    sums = parts_.groupBy("subset_id", "label", "pos").agg(F.sum(F.col("error") * F.col("x")).alias("slope"), F.count(F.lit(1)).alias("n"))
    sums = settle(sums, "sums")
    rows = sums.groupBy("subset_id", "label").agg(F.max("n").alias("rows"))
    values = weights.select("subset_id", "label", F.posexplode(F.concat("coefficients", F.array(F.lit(0.0)))).alias("pos", "w"))
    joined = values.join(sums, ["subset_id", "label", "pos"], "left").join(rows, ["subset_id", "label"])
    total = F.abs(F.coalesce("slope", F.lit(0.0)) + F.col("w")) / F.col("rows")
    return joined.groupBy("subset_id", "label").agg(F.first("rows").alias("rows"), (F.max(total) < 0.001).alias("at_optimum"))


# The seed documents by subset, every subset with a vocabulary of its own.
SUBSET_TERMS = rf"""{SEED}, {MAPPING}, own AS (SELECT subset_id, label, row_id, text FROM seed JOIN mapping USING (label)),
lists AS (SELECT subset_id, row_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
          lambda w: NOT list_contains([{STOP_SQL}], w)) AS ws FROM own),
terms AS (SELECT subset_id, row_id, unnest(ws) AS term FROM lists
          UNION ALL SELECT subset_id, row_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM lists),
tf AS (SELECT subset_id, row_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT subset_id, term, count(*) AS df FROM tf GROUP BY subset_id, term
          QUALIFY row_number() OVER (PARTITION BY subset_id ORDER BY sum(tf) DESC, term) <= 2000),
idf AS (SELECT subset_id, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab JOIN (SELECT subset_id, count(*) AS n FROM own GROUP BY 1) USING (subset_id)),
w AS (SELECT subset_id, row_id, tf.term, tf.tf * idf AS w FROM tf JOIN idf USING (subset_id, term))"""


def subset_terms(spark, sf):
    """Seed documents with their subset, the vocabularies, and the features in them."""
    known = mapping(spark, sf)
    rows = settle(maps.attach_subset(seed(spark, sf), known), "rows")
    vocab = sparse.subset_vocabulary(rows, 2_000)
    return known, vocab, settle(sparse.sparse_features(rows, vocab, ("row_id", "label")), "features")


@query(f"""WITH {SUBSET_TERMS} SELECT subset_id, row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 7) AS weight FROM w""")
def tfidf_by_subset(spark, sf):
    _, vocab, rows = subset_terms(spark, sf)
    cells = rows.select("subset_id", "row_id", F.inline(F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("weight"))))
    return cells.join(vocab, ["subset_id", "idx"]).select("subset_id", "row_id", "term", F.round("weight", 7).alias("weight"))


@query(f"""WITH {SEED}, {MAPPING}, own AS (SELECT subset_id, label FROM seed JOIN mapping USING (label)),
sizes AS (SELECT subset_id, count(*) AS rows FROM own GROUP BY subset_id) SELECT DISTINCT subset_id, label, rows, true AS at_optimum FROM own JOIN sizes USING (subset_id)""")
def train_tfidf(spark, sf):
    """The joint fit on TF-IDF weights: whether the penalised likelihood is flat at the fitted weights."""
    known, vocab, given = subset_terms(spark, sf)
    weights, _ = linear.fit_linear(lookup_join(given, maps.classes_of(known), ["subset_id", "label"]))
    rows = maps.attach_subset(seed(spark, sf), known)
    scored = sparse.score_sparse(rows, vocab, weights, ("row_id", "label"), own=True)
    each = scored.select("row_id", "subset_id", F.col("label").alias("true_label"), F.inline(F.arrays_zip(F.col("labels").alias("label"), F.col("probabilities").alias("p"))))
    each = each.withColumn("error", F.col("p") - (F.col("true_label") == F.col("label")).cast("double"))
    last = weights.groupBy("subset_id").agg(F.max(F.size("coefficients")).alias("pos"))
    cells = given.select("row_id", F.inline(F.arrays_zip(F.col("indices").alias("pos"), F.col("values").alias("x"))))
    ones = lookup_join(given.select("row_id", "subset_id"), last, "subset_id").select("row_id", "pos", F.lit(1.0).alias("x"))
    return at_optimum(each.join(cells.unionByName(ones), "row_id"), weights)


@query(f"""WITH {SEED}, {MAPPING}, own AS (SELECT subset_id, label, count(*) AS n FROM seed JOIN mapping USING (label) GROUP BY ALL),
classes AS (SELECT * FROM own UNION ALL SELECT subset_id, '__NOISE__', floor(avg(n) * 2)::BIGINT FROM own GROUP BY subset_id),
split AS (SELECT *, CASE WHEN n < 2 THEN n ELSE (n * 80 + 50) // 100 END AS train FROM classes)
SELECT subset_id, count(*) AS classes, sum(n)::BIGINT AS rows, sum(train)::BIGINT AS train_rows,
max(n) FILTER (label = '__NOISE__') AS noise_samples, true AS learned FROM split GROUP BY subset_id""")
def train_subsets_tfidf(spark, sf):
    """Training on TF-IDF weights with noise rows and synthetic sparse rows: rows, and whether it beats chance on them."""
    found = training.train_subsets(seed(spark, sf), mapping(spark, sf), Options(features="tfidf", max_features=2_000))
    joined = lookup_join(found.log, found.stats, "subset_id", "left")
    learned = F.col("error").isNull() & (F.col("train_accuracy") > 1 / F.col("classes"))
    return joined.select("subset_id", F.col("classes").cast("long").alias("classes"), "rows", "train_rows", "noise_samples", learned.alias("learned"))


@query(f"""WITH {VECTOR_MAPPING} SELECT subset_id, count(*) AS rows, true AS accurate FROM (SELECT 'c' || label AS label FROM embeddings)
JOIN mapping USING (label) GROUP BY subset_id""")
def train_forest(spark, sf):
    """A forest of full depth per subset: it knows its own training rows."""
    rows = training_table(spark, sf)
    fitted, _ = models.fit_subsets(rows, "random_forest")
    scored = models.score_models(rows, fitted, keep=("row_id", "label"), own=True)
    right = F.avg((F.col("label") == F.col("predicted_label")).cast("double"))
    return scored.groupBy("subset_id").agg(F.count(F.lit(1)).alias("rows"), (right >= 0.95).alias("accurate"))


def trained(spark, sf, options=Options()):
    return training.train_subsets(vectors(spark, sf), vector_mapping(spark, sf), options)


# Rows per class and subset with its noise rows, and how many of them train.
TRAINING = f"""{VECTOR_MAPPING}, own AS (SELECT subset_id, label, count(*) AS n FROM (SELECT 'c' || label AS label FROM embeddings)
  JOIN mapping USING (label) GROUP BY ALL),
classes AS (SELECT * FROM own UNION ALL SELECT subset_id, '__NOISE__', floor(avg(n) * 2)::BIGINT FROM own GROUP BY subset_id),
split AS (SELECT *, CASE WHEN n < 2 THEN n ELSE (n * 80 + 50) // 100 END AS train FROM classes)"""


@query(f"""WITH {TRAINING} SELECT subset_id, count(*) AS classes, sum(n)::BIGINT AS rows, sum(train)::BIGINT AS train_rows,
max(n) FILTER (label = '__NOISE__') AS noise_samples, true AS learned FROM split GROUP BY subset_id""")
def train_subsets(spark, sf):
    """Rows of every subset's classifier, and whether it beats chance on them."""
    found = trained(spark, sf)
    joined = lookup_join(found.log, found.stats, "subset_id", "left")
    learned = F.col("error").isNull() & (F.col("train_accuracy") > 1 / F.col("classes"))
    return joined.select("subset_id", F.col("classes").cast("long").alias("classes"), "rows", "train_rows", "noise_samples", learned.alias("learned"))


@query(f"WITH {TRAINING} SELECT subset_id, label, n - train AS support, true AS in_range FROM split WHERE n > train")
def training_report(spark, sf):
    """Validation rows per class and subset; scores are shares."""
    report = trained(spark, sf).report.where("support > 0")
    shares = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1_score")]
    return report.select("subset_id", "label", F.col("support").cast("long").alias("support"), (shares[0] & shares[1] & shares[2]).alias("in_range"))


@query(f"""WITH {VECTOR_MAPPING} SELECT subset_id, count(DISTINCT label) AS num_labels, true AS is_trained,
count(*) AS training_samples, 'logistic_regression' AS classifier_type
FROM (SELECT 'c' || label AS label FROM embeddings) JOIN mapping USING (label) GROUP BY subset_id""")
def training_summary(spark, sf):
    _, log = linear.fit_linear(training_table(spark, sf))
    return models.training_summary(log, vector_mapping(spark, sf), "logistic_regression")


def _saved(spark, sf):
    table = training_table(spark, sf)
    fitted, _ = models.fit_subsets(table, "logistic_regression")
    path = fresh_path(spark, "models")
    return table, fitted, path, state.save_models(spark, fitted, path, "logistic_regression")


@query(f"""WITH {VECTOR_MAPPING} SELECT subset_id, 'logistic_regression' AS kind, string_agg(label, ',' ORDER BY label) AS labels
FROM mapping GROUP BY subset_id""")
def save_models(spark, sf):
    return _saved(spark, sf)[3].select("subset_id", "kind", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {VECTOR_MAPPING} SELECT subset_id, (SELECT count(*) FROM embeddings) AS rows, 0 AS differing FROM mapping GROUP BY subset_id""")
def load_models(spark, sf):
    """Reloaded models predict what the fitted ones do."""
    table, fitted, path, _ = _saved(spark, sf)
    _, weights = state.load_models(spark, path)
    left = models.score_models(table, fitted).select("row_id", "subset_id", "predicted_label")
    right = models.score_linear(vectors(spark, sf).select("row_id", "vector"), weights)
    both = left.join(right.select("row_id", "subset_id", F.col("predicted_label").alias("reloaded")), ["row_id", "subset_id"])
    return both.groupBy("subset_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("predicted_label") != F.col("reloaded")).alias("differing"))


@query(f"""WITH {PARTS}, {PART_MAPPING}, now AS (SELECT subset_id, count(*) AS rows_now FROM parts JOIN mapping USING (label) GROUP BY subset_id),
old AS (SELECT subset_id, count(*) AS rows_then FROM parts JOIN mapping USING (label)
        WHERE subset_id <> 'subset_1' AND (subset_id <> 'subset_2' OR row_id % 3 = 0) GROUP BY subset_id
        UNION ALL SELECT subset_id, count(*) FROM parts JOIN mapping USING (label) WHERE subset_id = 'subset_1' GROUP BY subset_id)
SELECT subset_id, rows_now, rows_then FROM now LEFT JOIN old USING (subset_id) WHERE rows_now > coalesce(rows_then, 0)""")
def needs_retrain(spark, sf):
    """The third subset was fitted on a third of its rows."""
    rows = maps.attach_subset(parts(spark, sf), part_mapping(spark, sf))
    before = rows.where("subset_id <> 'subset_2' OR row_id % 3 = 0")
    return models.needs_retrain(rows, before.groupBy("subset_id").agg(F.count(F.lit(1)).alias("rows")))


def _loop_parts(spark, sf):
    """Components over the vectors: a third of them labelled."""
    rows = vectors(spark, sf).select(F.concat(F.lit("seed:"), F.col("row_id")).alias("row_id"), F.lit("").alias("text"), "label", "vector")
    known = vector_mapping(spark, sf)
    labelled = settle(rows.withColumn("vector", F.col("vector").cast("array<float>")), "labelled")
    weights = linear_models(spark, sf)
    return initial.Components(fresh_path(spark, "run"), labelled, known, None, None, {}, weights)


def _accepted(spark, sf):
    """Rows that a judge accepted: every other one of four labels."""
    return vectors(spark, sf).where("row_id % 2 = 0 AND label < 'c4'").select(
        F.col("row_id").cast("string"), F.lit("").alias("text"), "label", F.col("vector").cast("array<float>"),
        F.lit(0.8).alias("confidence"), F.lit("judge").alias("source"),
    )


@query(f"""WITH {VECTOR_MAPPING}, grown AS (SELECT subset_id, count(*) AS n FROM (SELECT 'c' || label AS label FROM embeddings
  UNION ALL SELECT 'c' || label FROM embeddings WHERE vec_id % 2 = 0 AND label < 4) JOIN mapping USING (label) GROUP BY subset_id)
SELECT subset_id, n AS rows, subset_id = 'subset_0' AS retrained FROM grown""")
def retrain(spark, sf):
    """Validated rows reach the first subset only, so only that one is refitted."""
    parts_ = _loop_parts(spark, sf)
    run_dir = fresh_path(spark, "loop")
    sizes = parts_.labelled.join(parts_.mapping, "label").groupBy("subset_id").agg(F.count(F.lit(1)).alias("rows"))
    state.append_rows(sizes.select("subset_id", F.lit(True).alias("retrained"), "rows"), run_dir, "fits", 0)
    state.append_rows(_accepted(spark, sf), run_dir, "validated", 1)
    active.retrain(spark, parts_, run_dir, 1, Options())
    return state.read_appended(spark, run_dir, "fits", active.FITS).where("iteration = 1").drop("iteration")


@query(f"""WITH {VECTOR_MAPPING} SELECT subset_id, count(*) AS rows, true AS retrained
FROM (SELECT 'c' || label AS label FROM embeddings) JOIN mapping USING (label) GROUP BY subset_id""")
def final_retrain(spark, sf):
    parts_ = _loop_parts(spark, sf)
    run_dir = fresh_path(spark, "loop")
    active.final_retrain(spark, parts_, run_dir, 1, Options())
    return active.load_final(spark, run_dir)[0]["fits"]


@query("""SELECT 'c' || label AS label, count(*) + count(*) FILTER (vec_id % 2 = 0 AND label < 4) AS n, count(*) FILTER (vec_id % 2 = 0 AND label < 4) AS validated
FROM embeddings GROUP BY label""")
def final_state(spark, sf):
    """The stored training table after the loop: seed rows and accepted ones."""
    parts_ = _loop_parts(spark, sf)
    run_dir = fresh_path(spark, "loop")
    state.append_rows(_accepted(spark, sf), run_dir, "validated", 1)
    active.final_retrain(spark, parts_, run_dir, 1, Options())
    table = active.load_final(spark, run_dir)[0]["training"]
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("row_id").startswith("pool:")).alias("validated"))


# balancing


def _uneven(spark, sf):
    """Vector rows with their subset; the classes are uneven by themselves."""
    return settle(maps.attach_subset(vectors(spark, sf), vector_mapping(spark, sf)), "uneven")


@query(f"""WITH {VECTOR_MAPPING}, c AS (SELECT subset_id, label, count(*) AS n FROM
  (SELECT 'c' || label AS label FROM embeddings) JOIN mapping USING (label) GROUP BY ALL)
SELECT subset_id, label, max(n) OVER (PARTITION BY subset_id) - n AS made FROM c QUALIFY made > 0""")
def smote(spark, sf):
    """Synthetic rows per class."""
    return balance.smote(_uneven(spark, sf)).groupBy("subset_id", "label").agg(F.count(F.lit(1)).alias("made"))


@query(f"""WITH {EMB}, {VECTOR_MAPPING}, items AS (SELECT subset_id, emb.label, row_id, v FROM emb JOIN mapping USING (label)),
c AS (SELECT subset_id, label, count(*) AS n FROM items GROUP BY ALL),
plan AS (SELECT *, max(n) OVER (PARTITION BY subset_id) - n AS need FROM c QUALIFY need > 0),
sims AS (SELECT q.subset_id, q.label, q.row_id, i.row_id AS item, i.v AS other, round(list_cosine_similarity(q.v, i.v), 9) AS s
  FROM items q JOIN plan USING (subset_id, label) JOIN items i ON i.subset_id = q.subset_id AND i.label = q.label AND i.row_id <> q.row_id),
near AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, item) AS rank FROM sims QUALIFY rank <= 5),
copies AS (SELECT items.*, need // n + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) <= need % n THEN 1 ELSE 0 END AS k
  FROM items JOIN plan USING (subset_id, label)),
made AS (SELECT subset_id, label, row_id, v, unnest(range(1, k + 1)) AS copy FROM copies),
drawn AS (SELECT *, ('0x' || substr(md5('42:' || row_id || ':' || copy), 1, 8))::BIGINT / 4294967296.0 AS f1,
  ('0x' || substr(md5('42:' || row_id || ':' || copy), 9, 8))::BIGINT / 4294967296.0 AS f2 FROM made),
moved AS (SELECT drawn.subset_id, drawn.label, drawn.row_id, copy, v, other, f2 FROM drawn JOIN near ON near.row_id = drawn.row_id AND rank = floor(f1 * 5) + 1)
SELECT subset_id, label, row_id, copy, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v) + f2 * (unnest(other) - unnest(v)), 9) AS value FROM moved""")
def smote_vectors(spark, sf):
    """The synthetic rows themselves."""
    made = balance.smote(_uneven(spark, sf))
    rows = made.select("subset_id", "label", "row_id", "copy", F.posexplode("vector").alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 9))


@query(f"""WITH {VECTOR_MAPPING}, c AS (SELECT subset_id, label, count(*) AS n FROM
  (SELECT 'c' || label AS label FROM embeddings) JOIN mapping USING (label) GROUP BY ALL)
SELECT subset_id, label, max(n) OVER (PARTITION BY subset_id) - n AS made, true AS recalled FROM c QUALIFY made > 0""")
def smote_refined(spark, sf):
    """Synthetic rows per class, all classes searched by refinement, and whether nine of ten neighbours are as near as the exact ones."""
    rows = _uneven(spark, sf)
    made = balance.smote(rows, exact_rows=0).groupBy("subset_id", "label").agg(F.count(F.lit(1)).alias("made"))
    items = rows.select("subset_id", "label", F.col("row_id").alias("item_id"), "vector")
    reached = refined.knn_refined(items, 5, ["subset_id", "label"]).agg(F.min("recall").alias("r")).first()["r"]
    return made.withColumn("recalled", F.lit(reached >= 0.9))


# the judge


def digest_judge():
    """A judge that answers by the digest of the whole request. It proves that the
    right request arrives, not that verdicts are good."""

    def answer(prompt):
        first = hashlib.md5(prompt.encode()).hexdigest()[0]
        return "True" if first < "8" else "False." if first < "c" else "true or false" if first < "e" else None

    return lambda asked: [answer(p) for p in asked]


WORD_CELLS = r"""words AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM keyed),
sums AS (SELECT key, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos,
                sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS s FROM words GROUP BY 1, 2),
grid AS (SELECT key, p.pos, coalesce(s, 0) AS s FROM keyed CROSS JOIN (SELECT range AS pos FROM range(64)) p LEFT JOIN sums USING (key, pos)),
vecs AS (SELECT key, list((CASE WHEN n > 0 THEN s / n ELSE 0 END)::FLOAT::DOUBLE ORDER BY pos) AS v
         FROM (SELECT key, pos, s, sqrt(sum(s * s) OVER (PARTITION BY key)) AS n FROM grid) GROUP BY key)"""
JUDGED = filled(
    K.BINARY_TEMPLATE, text="text", label="label", examples_section="coalesce(section, '')",
    description="'Text samples that belong to the ''' || label || ''' category'",
)
JUDGE_SQL = f"""WITH {BASE}, keyed AS (SELECT DISTINCT md5(text) AS key, text FROM docs), {WORD_CELLS},
asked AS (SELECT md5(text) AS key, label, min(row_id) AS qid, any_value(text) AS text FROM pool GROUP BY 1, 2),
sims AS (SELECT a.key, a.label, s.row_id, s.text, round(coalesce(
    CASE WHEN isnan(list_cosine_similarity(q.v, i.v)) THEN 0 ELSE list_cosine_similarity(q.v, i.v) END, 0), 9) AS similarity
  FROM asked a JOIN vecs q ON q.key = a.key JOIN seed s ON s.label = a.label JOIN vecs i ON i.key = md5(s.text)),
near AS (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY similarity DESC, row_id) AS rank FROM sims QUALIFY rank <= 6),
sections AS (SELECT key, label, count(*) AS n, 'Representative Examples:' || chr(10) ||
  string_agg(rank || '. "' || text || '"' || chr(10), '' ORDER BY rank) || chr(10) AS section FROM near GROUP BY ALL),
prompts AS (SELECT key, label, coalesce(n, 0) AS n, substr(md5({chat_sql('messages', JUDGED)}::VARCHAR), 1, 1) AS d FROM asked LEFT JOIN sections USING (key, label)),
answers AS (SELECT key, label, n, CASE WHEN d < '8' THEN 'True' WHEN d < 'c' THEN 'False.' WHEN d < 'e' THEN 'true or false' END AS reply FROM prompts)"""


def judged(spark, sf):
    """Pool rows judged against their document label, seed rows as examples."""
    rows = documents(spark, sf).select("row_id", "text", "label")
    empty = spark.createDataFrame([], features.EMPTY_CACHE)
    encoded, _ = features.embed_texts(rows, empty, features.word_hash_encoder(), "words")
    encoded = settle(encoded.withColumnRenamed("embedding", "vector").drop("key"), "encoded")
    labelled = encoded.join(seed(spark, sf).select("row_id"), "row_id", "left_semi")
    asked = encoded.join(pool(spark, sf).select("row_id"), "row_id", "left_semi").withColumnRenamed("label", "predicted_label")
    cache = spark.createDataFrame([], judge.CACHE_SCHEMA)
    none = spark.createDataFrame([], "label string, description string")
    return judge.judge_batch(asked, cache, labelled, none, digest_judge(), 6)


@query(JUDGE_SQL + """ SELECT row_id, pool.label AS predicted_label, reply, n::INTEGER AS n_examples,
CASE WHEN reply IS NULL THEN 'request failed' END AS error, coalesce(reply = 'True', false) AS is_valid,
CASE reply WHEN 'True' THEN 0.8 WHEN 'False.' THEN 0.8 WHEN 'true or false' THEN 0.3 ELSE 0.0 END AS confidence
FROM pool JOIN answers ON answers.key = md5(pool.text) AND answers.label = pool.label""")
def judge_batch(spark, sf):
    results, _ = judged(spark, sf)
    return results.select("row_id", "predicted_label", "reply", "n_examples", "error", "is_valid", "confidence")


@query(JUDGE_SQL + """ SELECT row_id, pool.label AS predicted_label, 0.8 AS confidence
FROM pool JOIN answers ON answers.key = md5(pool.text) AND answers.label = pool.label WHERE reply = 'True'""")
def select_valid(spark, sf):
    results, _ = judged(spark, sf)
    return cleaning.accepted(results, 0.5).select("row_id", "predicted_label", "confidence")


@query(f"""WITH {DESCRIBE} SELECT label, CASE WHEN md5(prompt) < 'e' THEN 'About ' || left(md5(prompt), 12)
ELSE 'Text samples that belong to the ''' || label || ''' category' END AS description FROM asked
UNION ALL SELECT '__NOISE__', 'Text samples that do not belong to any of the defined categories'
UNION ALL SELECT 'unseen', 'Text samples that belong to the ''unseen'' category'""")
def describe_labels(spark, sf):
    """Descriptions by digest; some requests fail, one label has no examples."""

    labels = documents(spark, sf).select("label").distinct().unionByName(
        spark.createDataFrame([(K.NOISE_LABEL,), ("unseen",)], "label string")
    )
    return judge.describe_labels(labels, seed(spark, sf), digest_writer)


@query(f"""WITH {RUNS}, s AS (SELECT run, count(*) FILTER (NOT cached) AS total_validations,
  count(*) FILTER (NOT cached AND reply IS NOT NULL AND is_valid) AS valid_predictions,
  count(*) FILTER (NOT cached AND reply IS NOT NULL AND NOT is_valid) AS invalid_predictions,
  count(*) FILTER (NOT cached AND reply IS NULL) AS request_errors, count(*) FILTER (cached) AS cache_hits FROM runs GROUP BY run)
SELECT *, round(valid_predictions / nullif(total_validations, 0), 9) AS validation_accuracy,
round(request_errors / nullif(total_validations, 0), 9) AS error_rate, round(cache_hits / nullif(total_validations, 0), 9) AS cache_hit_rate FROM s""")
def validation_summary(spark, sf):
    log = verdict_rows(spark, sf).withColumn("run", F.col("label"))
    found = judge.validation_summary(log, "run")
    for name in ("validation_accuracy", "error_rate", "cache_hit_rate"):
        found = found.withColumn(name, F.round(name, 9))
    return found


# histories


def run_log(spark, sf):
    from suite.fixtures import runs

    verdicts = verdict_rows(spark, sf).select("row_id", "is_valid")
    return runs(spark, sf).join(verdicts, "row_id")


@query(f"""WITH {RUNS} SELECT run, iteration, count(*) AS total_validated, count(*) FILTER (is_valid) AS valid_samples,
round(count(*) FILTER (is_valid) / count(*), 9) AS validation_rate FROM runs GROUP BY run, iteration""")
def iteration_metrics(spark, sf):
    found = progress.iteration_metrics(run_log(spark, sf), "run")
    return found.withColumn("validation_rate", F.round("validation_rate", 9))


@query(f"""WITH {HISTORY} SELECT run, round(sum(iteration_time), 6) AS total_processing_time, round(avg(iteration_time), 6) AS average_iteration_time,
min(iteration_time) AS min_iteration_time, max(iteration_time) AS max_iteration_time, count(*) AS total_iterations,
round(sum(validated_samples) / sum(iteration_time), 6) AS validation_efficiency FROM history GROUP BY run""")
def performance_stats(spark, sf):
    found = progress.performance_stats(history(spark, sf), "run")
    for name in ("total_processing_time", "average_iteration_time", "validation_efficiency"):
        found = found.withColumn(name, F.round(name, 6))
    return found


@query(f"""WITH {RUNS}, {MAPPING}, fits AS (SELECT iteration, 'subset_' || (row_id % 3) AS subset_id, is_valid AS retrained FROM runs )
SELECT iteration, count(DISTINCT subset_id) FILTER (retrained) AS retrained_classifiers, count(DISTINCT subset_id) AS total_classifiers
FROM fits GROUP BY iteration HAVING count(*) FILTER (retrained) > 0""")
def retrain_history(spark, sf):
    rows = run_log(spark, sf)
    subset = F.concat(F.lit("subset_"), (F.col("row_id") % 3).cast("string"))
    return progress.retrain_history(rows.select("iteration", subset.alias("subset_id"), F.col("is_valid").alias("retrained")))


STOPS = f"""{HISTORY}, firsts AS (SELECT run, min(iteration) FILTER (predictions_made = 0) AS f FROM history GROUP BY run)
SELECT run, iteration, predictions_made, CASE WHEN iteration > f THEN 'all_predicted' ELSE 'informative' END AS phase,
CAST(greatest(coalesce(iteration - f + 1, 0), 0) AS INTEGER) AS empty_count"""


@query(f"WITH {STOPS}, coalesce(iteration = f, false) AS stops_first, coalesce(iteration = f + 2, false) AS stops_later "
       "FROM history JOIN firsts USING (run)")
def al_stop(spark, sf):
    rows = history(spark, sf).select("run", "iteration", "predictions_made")
    first = progress.stop_points(rows, "run").withColumnRenamed("stops", "stops_first")
    later = progress.stop_points(rows, "run", mode="informative_then_all_predicted")
    return first.join(later.select("run", "iteration", F.col("stops").alias("stops_later")), ["run", "iteration"])


@query(f"""WITH {HISTORY} SELECT run, iteration, validated_samples,
(count(*) OVER w = 3 AND max(validation_rate) OVER w < 0.01) OR validated_samples = 0 AS converged FROM history
WINDOW w AS (PARTITION BY run ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def al_converged(spark, sf):
    return progress.converged(history(spark, sf), "run").select("run", "iteration", "validated_samples", "converged")


@query(f"""WITH {HISTORY}, t AS (SELECT run, iteration, validated_samples,
  (sum(validated_samples) OVER (PARTITION BY run ORDER BY iteration))::BIGINT AS cumulative_validated FROM history)
SELECT *, cumulative_validated // 3 > (cumulative_validated - validated_samples) // 3 AS due FROM t""")
def al_retrain_due(spark, sf):
    rows = history(spark, sf).select("run", "iteration", "validated_samples")
    return progress.retrain_due(rows, "run", threshold=3)


# the runs

# Half of the pool per iteration, and nothing else cut.
HALVES = Options(batch_share=0.5)


def digest_writer(asked):
    """Label descriptions by the digest of the prompt; some requests fail."""
    digests = [hashlib.md5(p.encode()).hexdigest() for p in asked]
    return [f" About {d[:12]}\n" if d < "e" else None for d in digests]


def initial_run(spark, sf):
    return initial.run_initial(
        spark, seed(spark, sf), fresh_path(spark, "run"), features.word_hash_encoder(), digest_writer, HALVES, "words"
    )


@query(f"""WITH {SEED} SELECT label, count(*) AS n FROM seed GROUP BY label UNION ALL SELECT '__NOISE__', 0""")
def run_initial(spark, sf):
    """Rows per label after initial training on the seed documents; for the noise class, by how many rows
    the subsets miss twice the mean of their classes."""
    classes = settle(initial_run(spark, sf).trained.distribution, "classes")
    noise = F.col("label") == K.NOISE_LABEL
    wanted = F.floor(F.avg(F.when(~noise, F.col("n"))) * 2)
    missed = classes.groupBy("subset_id").agg(F.abs(wanted - F.max(F.when(noise, F.col("n")))).alias("n"))
    total = missed.agg(F.lit(K.NOISE_LABEL).alias("label"), F.sum("n").cast("long").alias("n"))
    return classes.where(~noise).select("label", "n").unionByName(total)


def active_run(spark, sf, options=HALVES):
    found = initial_run(spark, sf)
    rows = pool(spark, sf).select("row_id", "text")
    return active.run_active(
        spark, found, rows, fresh_path(spark, "loop"), features.word_hash_encoder(), digest_judge(), options, "words"
    )


BATCHES = f"""{BASE}, asked AS (SELECT row_id FROM pool WHERE trim(text, ' \n\t') <> ''),
sizes AS (SELECT count(*) AS p, ceil(count(*) * 0.5)::BIGINT AS b FROM asked)"""


@query(f"""WITH {BATCHES} SELECT i::INTEGER AS iteration, least(b, greatest(p - (i - 1) * b, 0))::BIGINT AS batch_size, true AS consistent
FROM (SELECT p, b, unnest(range(1, CAST(ceil(p / b) AS BIGINT) + 2)) AS i FROM sizes)""")
def run_active(spark, sf):
    """The loop over the whole pool: batches, and whether the counts of each iteration agree and retraining
    comes exactly when the accepted rows pass another multiple of the threshold."""
    rows = active_run(spark, sf).history
    before = F.col("cumulative_validated") - F.col("validated_samples")
    due = F.floor(F.col("cumulative_validated") / 100) > F.floor(before / 100)
    total = F.sum("validated_samples").over(Window.orderBy("iteration"))  # one row per iteration
    fine = (
        (F.col("validated_samples") <= F.col("judged"))
        & (F.col("judged") == F.col("predictions_made"))
        & ((F.col("retrained_classifiers") > 0) == due)
        & (F.col("cumulative_validated") == total)
    )
    return rows.select(F.col("iteration").cast("int").alias("iteration"), "batch_size", fine.alias("consistent"))


@query(f"""WITH {BATCHES} SELECT b AS batch, 0 AS outside, 0 AS unknown, 0 AS wrong FROM sizes""")
def al_iteration(spark, sf):
    """One iteration over the first batch of the pool: verdicts on other rows, on labels that nobody
    knows, and accepted ones without confidence."""
    found = initial_run(spark, sf)
    run_dir = fresh_path(spark, "loop")
    rows = active.pool_table(spark, pool(spark, sf).select("row_id", "text"), run_dir)
    size = -(-rows.count() // 2)
    active.run_iteration(
        spark, found, rows, size, run_dir, 1, "informative", features.word_hash_encoder(), digest_judge(), HALVES, "words", 0
    )
    log = state.read_appended(spark, run_dir, "log", active.LOG)
    batch = rows.where(F.col("position") < size).select("row_id", F.lit(True).alias("inside"))
    known = found.mapping.select(F.col("label").alias("predicted_label"), F.lit(True).alias("known"))
    joined = lookup_join(log.join(batch, "row_id", "left"), known, "predicted_label", "left")
    wrong = F.col("is_valid") & (F.col("confidence") < 0.5)
    return joined.agg(
        F.lit(size).cast("long").alias("batch"), F.count_if(F.col("inside").isNull()).alias("outside"),
        F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(wrong).alias("wrong"),
    )


# arriving texts


# Bytes of a table that one arriving file holds about.
FILE_BYTES = 32 * 1024 * 1024


def arriving_files(frame):
    """How many files a table arrives in: four, or more by its size."""
    return max(4, 2 * -(-estimated_bytes(frame) // (2 * FILE_BYTES)))


def _arriving(spark, frame):
    """A table as at least four files, read in two micro-batches."""
    path, files = fresh_path(spark, "arrivals"), arriving_files(frame)
    frame.repartitionByRange(files, "row_id").write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files // 2).parquet(path)


@query(f"WITH {SCORED} SELECT row_id, subset_id, predicted_label, uncertainty FROM preds WHERE predicted_label <> '__NOISE__'")
def stream_score(spark, sf):
    """Vectors scored on arrival: the predictions of all micro-batches."""
    out = fresh_path(spark, "stream")
    stream = _arriving(spark, vectors(spark, sf).select("row_id", "vector"))
    arrivals.stream_score(stream, lambda batch: batch, linear_models(spark, sf), out, 20)
    schema = "row_id long, subset_id string, predicted_label string, uncertainty double"
    found = state.read_appended(spark, out, "predictions", schema).drop("iteration")
    return found.withColumn("uncertainty", F.round("uncertainty", 9))


@query(f"""WITH {DOCS} SELECT count(DISTINCT (md5(text), label)) AS asked, count(DISTINCT (md5(text), label)) AS pairs FROM docs""")
def stream_cache_dedup(spark, sf):
    """Every (text, label) pair is asked once, over all micro-batches."""
    out = fresh_path(spark, "stream")

    def prompt(text, label):
        return prompts.binary_prompt(text, label, prompts.default_description(label), F.array().cast("array<string>"), 6)

    stream = _arriving(spark, documents(spark, sf).select("row_id", "text", F.col("label").alias("predicted_label")))
    arrivals.stream_judge(stream, lambda asked: ["True" for _ in asked], prompt, out)
    found = state.read_appended(spark, out, "verdicts", judge.CACHE_SCHEMA)
    return found.agg(F.count(F.lit(1)).alias("asked"), F.count_distinct(*judge.PAIR).alias("pairs"))


@query(f"""WITH {DOCS}, valid AS (SELECT DISTINCT md5(text) AS key, label FROM docs WHERE text IS NOT NULL AND label IS NOT NULL)
SELECT count(*) AS asked, count(*) AS pairs, 0 AS asked_later FROM valid""")
def stream_state_dedup(spark, sf):
    """Every pair is asked once with the asked pairs as streaming state; the same rows arriving at a restarted stream ask nothing."""
    out, path = fresh_path(spark, "stream"), fresh_path(spark, "arrivals")
    rows = documents(spark, sf).select("row_id", "text", F.col("label").alias("predicted_label"))
    files = arriving_files(rows)

    def prompt(text, label):
        return prompts.binary_prompt(text, label, prompts.default_description(label), F.array().cast("array<string>"), 6)

    def run():
        rows.repartitionByRange(files, "row_id").write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(path)
        arrivals.stream_judge_once(spark, stream, lambda asked: ["True" for _ in asked], prompt, out)
        return settle(state.read_appended(spark, out, "verdicts", judge.CACHE_SCHEMA), "asked")

    before = run()
    after = run()
    later = after.count() - before.count()
    return after.agg(
        F.count(F.lit(1)).alias("asked"), F.count_distinct(*judge.PAIR).alias("pairs"), F.lit(later).cast("int").alias("asked_later")
    )
