"""Vector joins, label space and prediction ranking."""

from pyspark.sql import functions as F

from suite.fixtures import (
    CENT, DOCS, EMB, MAPPING, PAIRS, SCORED, documents, linear_models, mapping, pairs, predictions, probabilities, vector_mapping, vectors,
)
from suite.registry import query
from tagmill.constants import NOISE_LABEL
from tagmill.functions import vectors as V
from tagmill.functions.scores import entropy_bits, proxy_probabilities
from tagmill.operators import evaluate, labelspace, models, neighbours
from tagmill.operators.mapping import nested_mapping
from tagmill.sources.vectorindex import VectorIndex
from tagmill.storage import fresh_path, lookup_join, settle


def sides(spark, sf, *keep):
    rows = vectors(spark, sf)
    return (
        rows.select(F.col("row_id").alias("query_id"), "vector", *keep),
        rows.select(F.col("row_id").alias("item_id"), "vector", *keep),
    )


SIMS = f"""{EMB}, sims AS (
  SELECT q.row_id AS query_id, i.row_id AS item_id, q.label AS query_label, i.label AS item_label,
         round(list_cosine_similarity(q.v, i.v), 9) AS similarity FROM emb q, emb i)"""


@query(f"""WITH {SIMS} SELECT query_id, item_id, similarity,
row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM sims QUALIFY rank <= 5""")
def knn_join_exact(spark, sf):
    return neighbours.knn_join(*sides(spark, sf), 5)


@query(f"""WITH {SIMS} SELECT query_id, item_id, query_label AS label, similarity,
row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM sims
WHERE query_label = item_label QUALIFY rank <= 6""")
def knn_join_label(spark, sf):
    return neighbours.knn_join(*sides(spark, sf, "label"), 6, on=["label"])


@query(f"""WITH {SIMS}, wide AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS r
FROM sims QUALIFY r <= 10)
SELECT query_id, item_id, similarity, item_label AS label,
row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank
FROM wide WHERE similarity >= 0 AND query_label = item_label QUALIFY rank <= 5""")
def knn_join_postfilter(spark, sf):
    return neighbours.knn_then_filter(*sides(spark, sf, "label"), 5)


@query("SELECT sum(n * least(6, n))::BIGINT AS pairs, true AS recalled FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def knn_join_indexed(spark, sf):
    """Whether a stored index, made from every other row and grown by the rest, finds nine of ten exact neighbours of the same label."""
    rows = settle(vectors(spark, sf).withColumn("item_id", F.col("row_id").cast("string")).withColumn("text", F.col("item_id")), "rows")
    index = VectorIndex(fresh_path(spark, "index"))
    first = F.pmod(F.xxhash64("item_id"), F.lit(2)) == 0
    index.create(rows.where(first))
    index.add(rows.where(~first), 1)
    queries = rows.select(F.col("row_id").alias("query_id"), "label", "vector")
    exact = neighbours.knn_join(queries, rows.select("item_id", "label", "vector"), 6, on=["label"])
    found = neighbours.recall(index.nearest(queries, 6), exact)
    return found.select("pairs", (F.col("recall") >= 0.9).alias("recalled"))


@query("SELECT 5 * count(*) AS pairs, true AS recalled, true AS fewer FROM embeddings")
def knn_join_approx(spark, sf):
    """Whether nine of ten exact neighbours are found, with fewer comparisons than all pairs."""
    found = settle(neighbours.knn_join_probed(*sides(spark, sf), 5), "found")
    share = found.first()["share"]
    exact = neighbours.recall(found, neighbours.knn_join(*sides(spark, sf), 5))
    return exact.select("pairs", (F.col("recall") >= 0.9).alias("recalled"), F.lit(share < 1).alias("fewer"))


@query(f"""WITH {CENT}, ranked AS (
  SELECT emb.row_id, cent.label, round(list_cosine_similarity(v, c), 9) AS similarity FROM emb, cent)
SELECT row_id, label, similarity, row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC, label) AS rank
FROM ranked QUALIFY rank <= 3""")
def topk_similar(spark, sf):
    rows = vectors(spark, sf).select(F.col("row_id").alias("query_id"), "vector")
    centers = labelspace.centroids(vectors(spark, sf), "label").withColumnRenamed("label", "item_id")
    found = neighbours.knn_join(rows, centers, 3)
    return found.select(F.col("query_id").alias("row_id"), F.col("item_id").alias("label"), "similarity", "rank")


@query(f"WITH {EMB} SELECT a.row_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity "
       "FROM emb a JOIN emb b ON b.row_id = a.row_id + 1", name="cosine")
def cosine_of_next(spark, sf):
    rows = vectors(spark, sf).select("row_id", "vector")
    other = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("vector").alias("other"))
    return rows.join(other, "row_id").select("row_id", F.round(V.cosine(F.col("vector"), F.col("other")), 9).alias("similarity"))


@query(f"""WITH {EMB} SELECT row_id, generate_subscripts(v, 1) - 1 AS pos,
round(unnest(v) * 3 / sqrt(list_dot_product(list_transform(v, lambda x: x * 3), list_transform(v, lambda x: x * 3))), 9) AS value FROM emb""")
def l2_normalize(spark, sf):
    tripled = F.transform("vector", lambda x: x * 3)
    rows = vectors(spark, sf).select("row_id", F.posexplode(V.unit(tripled)).alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 9))


@query(f"""WITH {CENT} SELECT a.label, b.label AS other,
round(list_cosine_similarity(a.c, b.c), 9) AS similarity FROM cent a JOIN cent b ON a.label < b.label""")
def label_similarity(spark, sf):
    return labelspace.label_similarity(settle(labelspace.centroids(vectors(spark, sf), "label"), "centres"))


@query(f"""WITH {CENT}, p AS (SELECT a.label AS target, b.label, round(list_cosine_similarity(a.c, b.c), 9) AS similarity
FROM cent a JOIN cent b ON a.label <> b.label)
SELECT target, label, similarity FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY similarity, label) = 1""")
def argmin_similarity(spark, sf):
    return labelspace.least_similar(settle(labelspace.centroids(vectors(spark, sf), "label"), "centres"))


@query(f"""WITH {CENT} SELECT label, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 9) AS value FROM cent""")
def label_vectors(spark, sf):
    rows = labelspace.centroids(vectors(spark, sf), "label")
    return rows.select("label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 9))


# Free labels are told by a concatenated list of taken ones; the sum of the members'
# similarities stands for the similarity to their mean.
GREEDY = f"""WITH RECURSIVE {CENT},
w AS (SELECT a.label AS member, b.label AS free, list_dot_product(a.c, b.c) / sqrt(list_dot_product(b.c, b.c)) AS w FROM cent a, cent b),
steps AS (
  SELECT 0 AS step, (SELECT min(label) FROM cent) AS label, [(SELECT min(label) FROM cent)] AS taken, [(SELECT min(label) FROM cent)] AS current
  UNION ALL
  SELECT step + 1, pick, list_append(taken, pick), CASE WHEN len(current) = 4 THEN [pick] ELSE list_append(current, pick) END
  FROM (SELECT s.*, CASE WHEN len(s.current) = 4
      THEN (SELECT min(label) FROM cent WHERE NOT list_contains(s.taken, label))
      ELSE (SELECT arg_min(free, t) FROM (SELECT free, sum(w) AS t FROM w
            WHERE list_contains(s.current, member) AND NOT list_contains(s.taken, free) GROUP BY free)) END AS pick
    FROM steps s WHERE step + 1 < (SELECT count(*) FROM cent)))
SELECT 'subset_' || (step // 4) AS subset_id, step % 4 AS pos, label FROM steps"""


@query(GREEDY)
def greedy_subsets(spark, sf):
    return labelspace.greedy_subsets(labelspace.centroids(vectors(spark, sf), "label"), 4)


@query("SELECT range AS pos, (SELECT count(*) FROM embeddings) AS n, true AS ordered, true AS uncorrelated FROM range(32)")
def reduce_dims(spark, sf):
    """Components come with falling variance and without correlation to the next one."""
    rows = vectors(spark, sf).select("row_id", "vector")
    cells = settle(labelspace.reduce_dims(rows, 32).select("row_id", F.posexplode("vector").alias("pos", "x")), "cells")
    after = cells.select("row_id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("y"))
    both = cells.join(after, ["row_id", "pos"], "left").groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v"), F.var_pop("y").alias("w"), F.corr("x", "y").alias("r")
    )
    ordered = F.coalesce(F.col("v") >= F.col("w") * (1 - 1e-9), F.lit(True))
    return both.select(F.col("pos").cast("long").alias("pos"), "n", ordered.alias("ordered"), (F.coalesce(F.abs("r"), F.lit(0.0)) < 1e-6).alias("uncorrelated"))


# predictions


@query(f"WITH {SCORED} SELECT row_id, subset_id, predicted_label, uncertainty, max_probability FROM preds")
def score_all_subsets(spark, sf):
    """Every row against all subsets in one pass over stacked weights."""
    scored = models.score_linear(vectors(spark, sf).select("row_id", "vector"), linear_models(spark, sf))
    return scored.select(
        "row_id", "subset_id", "predicted_label",
        F.round("uncertainty", 9).alias("uncertainty"), F.round("max_probability", 9).alias("max_probability"),
    )


@query(f"WITH {SCORED} SELECT row_id, subset_id, predicted_label FROM preds")
def predict(spark, sf):
    scored = models.score_linear(vectors(spark, sf).select("row_id", "vector"), linear_models(spark, sf))
    return scored.select("row_id", "subset_id", "predicted_label")


@query(f"WITH {SCORED} SELECT row_id, subset_id, label, round(p, 9) AS probability FROM probs")
def predict_proba(spark, sf):
    scored = models.score_linear(vectors(spark, sf).select("row_id", "vector"), linear_models(spark, sf))
    cells = F.inline(F.arrays_zip(F.col("labels").alias("label"), F.col("probabilities").alias("p")))
    rows = scored.select("row_id", "subset_id", cells.alias("label", "p"))
    return rows.select("row_id", "subset_id", "label", F.round("p", 9).alias("probability"))


@query(f"WITH {SCORED} SELECT row_id, subset_id, uncertainty FROM preds")
def uncertainty(spark, sf):
    scored = models.score_linear(vectors(spark, sf).select("row_id", "vector"), linear_models(spark, sf))
    return scored.select("row_id", "subset_id", F.round("uncertainty", 9).alias("uncertainty"))


@query(f"WITH {SCORED} SELECT row_id, subset_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 9) AS entropy FROM probs GROUP BY ALL",
       name="entropy_bits")
def entropy_of_rows(spark, sf):
    return probabilities(spark, sf).select("row_id", "subset_id", F.round(entropy_bits(F.col("probabilities")), 9).alias("entropy"))


@query(f"WITH {SCORED} SELECT row_id, subset_id, predicted_label, max_probability FROM preds")
def argmax_class(spark, sf):
    found = models.with_scores(probabilities(spark, sf), ("row_id", "subset_id"))
    return found.select("row_id", "subset_id", "predicted_label", F.round("max_probability", 9).alias("max_probability"))


@query(f"""WITH {SCORED} SELECT row_id, subset_id, predicted_label, uncertainty FROM preds
WHERE predicted_label <> '__NOISE__' ORDER BY uncertainty DESC, subset_id, row_id LIMIT 100""")
def topk_uncertain(spark, sf):
    known = predictions(spark, sf).where(F.col("predicted_label") != NOISE_LABEL)
    return models.most_uncertain(known.select("row_id", "subset_id", "predicted_label", "uncertainty"), 100)


@query(f"""WITH {SCORED} SELECT row_id, subset_id, predicted_label, uncertainty, max_probability,
row_number() OVER (PARTITION BY subset_id ORDER BY uncertainty DESC, row_id) AS place FROM preds QUALIFY place <= 10""")
def topk_uncertain_per_subset(spark, sf):
    return models.most_uncertain_per_subset(predictions(spark, sf), 10).drop("labels", "probabilities")


@query(f"""WITH {DOCS}, {MAPPING}, c AS (SELECT subset_id, label FROM mapping UNION ALL SELECT DISTINCT subset_id, '__NOISE__' FROM mapping),
sized AS (SELECT subset_id, label, count(*) OVER (PARTITION BY subset_id) AS n FROM c),
rows_ AS (SELECT row_id, docs.label AS predicted, 'subset_' || (row_id % 3) AS subset_id FROM docs)
SELECT row_id, subset_id, sized.label, round(CASE WHEN predicted NOT IN (SELECT label FROM c WHERE c.subset_id = rows_.subset_id) THEN 0
WHEN predicted = sized.label THEN 0.9 ELSE 0.1 / (n - 1) END, 12) AS probability FROM rows_ JOIN sized USING (subset_id)""")
def proxy_proba(spark, sf):
    """Probabilities for a model that names a label only; the label is the document's."""
    classes = nested_mapping(mapping(spark, sf)).select(
        "subset_id", F.concat("labels", F.array(F.lit(NOISE_LABEL))).alias("labels")
    )
    subset = F.concat(F.lit("subset_"), (F.col("row_id") % 3).cast("string"))
    rows = lookup_join(documents(spark, sf).select("row_id", "label", subset.alias("subset_id")), classes, "subset_id")
    p = proxy_probabilities(F.col("label"), F.col("labels"))
    cells = rows.select("row_id", "subset_id", F.inline(F.arrays_zip(F.col("labels").alias("label"), p.alias("p"))).alias("label", "p"))
    return cells.select("row_id", "subset_id", "label", F.round("p", 12).alias("probability"))


@query(f"""WITH {SCORED}, owners AS (SELECT label AS true_label, subset_id FROM mapping WHERE label <> 'c9')
SELECT emb.row_id, emb.label AS true_label, owners.subset_id, coalesce(preds.predicted_label, '__NOISE__') AS predicted_label
FROM emb LEFT JOIN owners ON owners.true_label = emb.label
LEFT JOIN preds ON preds.row_id = emb.row_id AND preds.subset_id = owners.subset_id""")
def oracle_route(spark, sf):
    truth = vectors(spark, sf).select("row_id", F.col("label").alias("true_label"))
    known = vector_mapping(spark, sf).where("label <> 'c9'")
    return evaluate.route_by_truth(truth, known, predictions(spark, sf))


@query(f"""WITH {SCORED} SELECT row_id, arg_max(predicted_label, (CASE WHEN predicted_label <> '__NOISE__' THEN 1 ELSE 0 END, max_probability, subset_id)) AS predicted_label
FROM preds GROUP BY row_id""")
def honest_route(spark, sf):
    return evaluate.route_by_score(predictions(spark, sf))


# evaluation


@query(f"WITH {PAIRS} SELECT subset_id, avg((true_label = predicted_label)::INT) AS accuracy, count(*) AS n FROM pairs GROUP BY subset_id")
def eval_accuracy(spark, sf):
    found = evaluate.accuracy(pairs(spark, sf), "subset_id")
    return found


PER_CLASS = f"""{PAIRS}, names AS (SELECT true_label AS label FROM pairs UNION SELECT predicted_label FROM pairs),
c AS (SELECT label, (SELECT count(*) FROM pairs WHERE true_label = label) AS support,
  (SELECT count(*) FROM pairs WHERE predicted_label = label) AS predicted,
  (SELECT count(*) FROM pairs WHERE predicted_label = label AND true_label = label) AS hits FROM names),
pr AS (SELECT label, support, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM c),
per_class AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score, support FROM pr)"""


def _rounded(frame):
    for name in ("precision", "recall", "f1_score", "accuracy"):
        if name in frame.columns:
            frame = frame.withColumn(name, F.round(name, 9))
    return frame


@query(f"WITH {PER_CLASS} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support FROM per_class")
def eval_per_class(spark, sf):
    return _rounded(evaluate.per_class(pairs(spark, sf)))


@query(f"""WITH {PER_CLASS} SELECT round(sum(precision * support) / sum(support), 9) AS precision,
round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1_score * support) / sum(support), 9) AS f1_score,
sum(support)::BIGINT AS support FROM per_class""")
def eval_weighted_prf(spark, sf):
    return _rounded(evaluate.weighted_scores(pairs(spark, sf)))


@query(f"""WITH {PER_CLASS} SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
round(avg(f1_score), 9) AS f1_score, sum(support)::BIGINT AS support FROM per_class""")
def eval_macro(spark, sf):
    return _rounded(evaluate.macro_scores(pairs(spark, sf)))


@query(f"""WITH {PER_CLASS}, counted AS (SELECT true_label, predicted_label, count(*) AS n FROM pairs GROUP BY ALL)
SELECT a.label AS true_label, b.label AS predicted_label, coalesce(n, 0) AS n FROM names a CROSS JOIN names b
LEFT JOIN counted ON counted.true_label = a.label AND counted.predicted_label = b.label""")
def confusion_matrix(spark, sf):
    """The zero-filled form over all labels, which is the result's own size."""
    rows = settle(pairs(spark, sf), "pairs")
    return evaluate.confusion(rows, evaluate.all_labels(evaluate.pair_counts(rows)))


@query(f"""WITH {PAIRS}, m AS (
  SELECT subset_id, t.label, count(*) FILTER (true_label = t.label) AS support, count(*) FILTER (predicted_label = t.label) AS predicted,
         count(*) FILTER (true_label = t.label AND predicted_label = t.label) AS hits
  FROM pairs, (SELECT true_label AS label FROM pairs UNION SELECT predicted_label FROM pairs) t GROUP BY subset_id, t.label),
s AS (SELECT subset_id, support, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM m WHERE support + predicted > 0)
SELECT subset_id AS run, round(sum(p * support) / sum(support), 9) AS precision, round(sum(r * support) / sum(support), 9) AS recall,
round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support), 9) AS f1_score, sum(support)::BIGINT AS support,
(SELECT round(avg((true_label = predicted_label)::INT), 9) FROM pairs WHERE pairs.subset_id = s.subset_id) AS accuracy
FROM s GROUP BY subset_id""")
def comparison_table(spark, sf):
    """One summary per run; here a run is the predictions of one subset."""
    return _rounded(evaluate.comparison_table(pairs(spark, sf).withColumnRenamed("subset_id", "run"), "run"))
