"""Tables derived from the given ones, in Spark and in SQL.

Labelled text is ``documents`` with ``source`` as label. Documents with a row in
``labels`` are the seed, the others the pool; English pool rows stand for rows that a
judge accepted. ``part`` is the table with many labels. ``embeddings`` gives vectors.
"""

from pyspark.sql import functions as F

from tagmill.functions.vectors import doubles, unit
from tagmill.constants import NOISE_LABEL
from tagmill.operators.labelspace import centroids
from tagmill.operators.mapping import classes_of, fixed_mapping
from tagmill.operators.models import score_linear
from tagmill.functions.scores import softmax
from tagmill.storage import lookup_join, pair_with, settle


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.col("source").alias("label"), "lang"
    )


def judged_ids(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))


def seed(spark, sf):
    return documents(spark, sf).join(judged_ids(spark, sf), "row_id", "left_semi").drop("lang")


def pool(spark, sf):
    return documents(spark, sf).join(judged_ids(spark, sf), "row_id", "left_anti")


def validated(spark, sf):
    return pool(spark, sf).where("lang = 'en'").drop("lang")


def parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text"), F.col("p_brand").alias("label")
    )


def mapping(spark, sf, size=8):
    """Fixed mapping of the document labels."""
    return settle(fixed_mapping(documents(spark, sf).select("label").distinct(), size), "mapping")


def part_mapping(spark, sf, size=8):
    """Mapping of the part labels; the last label stays unmapped."""
    labels = parts(spark, sf).select("label").distinct()
    last = labels.agg(F.max("label")).first()[0]
    return settle(fixed_mapping(labels.where(F.col("label") < last), size), "mapping")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        doubles(F.col("embedding")).alias("vector"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
    )


def vector_mapping(spark, sf, size=4, drop_last=False):
    labels = vectors(spark, sf).select("label").distinct()
    return settle(fixed_mapping(labels.where("label <> 'c9'") if drop_last else labels, size), "mapping")


def linear_models(spark, sf):
    """A linear model per subset: ten times the unit centroid of each label, and of
    all rows for the noise class."""
    rows = vectors(spark, sf)
    own = centroids(rows, "label")
    everything = centroids(rows).select(F.lit(NOISE_LABEL).alias("label"), "vector")
    weights = own.unionByName(everything).select(
        "label", F.transform(unit(F.col("vector")), lambda x: x * 10).alias("coefficients")
    )
    classes = classes_of(vector_mapping(spark, sf))
    return settle(
        lookup_join(classes, weights, "label").select(
            "subset_id", "class_idx", "label", F.lit(0.0).alias("intercept"), "coefficients"
        ),
        "models",
    )


def probabilities(spark, sf):
    """``row_id, subset_id, labels, probabilities`` from those models."""
    ordered = F.sort_array(F.collect_list(F.struct("class_idx", "label", "coefficients")))
    nested = linear_models(spark, sf).groupBy("subset_id").agg(ordered.alias("_classes"))
    grid = pair_with(vectors(spark, sf).select("row_id", "vector"), nested, "subset_id")
    logits = F.transform(
        "_classes",
        lambda c: F.aggregate(
            F.zip_with(F.col("vector"), c["coefficients"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
        ),
    )
    return grid.withColumn("_logits", logits).select(
        "row_id",
        "subset_id",
        F.transform("_classes", lambda c: c["label"]).alias("labels"),
        softmax(F.col("_logits")).alias("probabilities"),
    )


def predictions(spark, sf):
    scored = score_linear(vectors(spark, sf).select("row_id", "vector"), linear_models(spark, sf))
    return scored.withColumn("uncertainty", F.round("uncertainty", 9)).withColumn(
        "max_probability", F.round("max_probability", 9)
    )


def pairs(spark, sf):
    """True and predicted label per row and subset that could have been right."""
    truth = vectors(spark, sf).select("row_id", F.col("label").alias("true_label"))
    return predictions(spark, sf).select("row_id", "subset_id", "predicted_label").join(truth, "row_id")


def replies(spark, sf):
    """Judge text per document: from ``labels.quality``, none asked otherwise."""
    quality = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    text = (
        F.when(F.col("toxic") == 1, F.lit(None).cast("string"))
        .when(F.col("quality") == 1, F.concat(F.lit(" True."), F.lit("\n")))
        .when(F.col("quality") == 0, F.lit("FALSE"))
        .otherwise(F.lit("true or false, indeterminate"))
    )
    rows = documents(spark, sf).join(quality, "row_id", "left")
    return rows.select("row_id", "text", "label", "lang", text.alias("reply"), F.col("quality").isNull().alias("cached"))


def runs(spark, sf):
    """Documents as judged rows of several runs: the label is the run, ten
    iterations each by document id."""
    ids = table(spark, sf, "documents").agg(F.max("doc_id") + 1).first()[0]
    iteration = F.floor(F.col("row_id") * 10 / ids) + 1
    return replies(spark, sf).withColumn("run", F.col("label")).withColumn("iteration", iteration.cast("int"))


def history(spark, sf):
    """One row per run and iteration. A French document counts as a prediction, a
    French document judged good as accepted."""
    rows = runs(spark, sf)
    french = F.col("lang") == "fr"
    good = french & F.coalesce(F.lower("reply").contains("true") & ~F.lower("reply").contains("false"), F.lit(False))
    return rows.groupBy("run", "iteration").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.count_if(french).alias("predictions_made"),
        F.count_if(good).alias("validated_samples"),
        (F.sum(F.length("text")) / 1000).alias("iteration_time"),
        F.coalesce(F.try_divide(F.count_if(good), F.count_if(french)), F.lit(0.0)).alias("validation_rate"),
    )


SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"

DOCS = "docs AS (SELECT doc_id AS row_id, text, source AS label, lang FROM documents)"
SEED = f"{DOCS}, seed AS (SELECT row_id, text, label FROM docs WHERE row_id IN (SELECT doc_id FROM labels))"
POOL = "pool AS (SELECT row_id, text, label, lang FROM docs WHERE row_id NOT IN (SELECT doc_id FROM labels))"
VALIDATED = "validated AS (SELECT row_id, text, label FROM pool WHERE lang = 'en')"
BASE = f"{SEED}, {POOL}, {VALIDATED}"


def mapping_sql(labels, size=8, name="mapping"):
    return f"""{name} AS (
        SELECT 'subset_' || ((r - 1) // {size}) AS subset_id, (r - 1) % {size} AS pos, label
        FROM (SELECT label, row_number() OVER (ORDER BY label) AS r FROM (SELECT DISTINCT label FROM {labels})))"""


MAPPING = mapping_sql("docs")
PARTS = "parts AS (SELECT p_partkey AS row_id, p_name AS text, p_brand AS label FROM part)"
PART_MAPPING = (
    "mapped_labels AS (SELECT label FROM parts WHERE label < (SELECT max(label) FROM parts)), "
    + mapping_sql("mapped_labels")
)

EMB = """emb AS (
    SELECT vec_id AS row_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'c' || label AS label FROM embeddings)"""
CENT = f"""{EMB},
cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb),
cent AS (SELECT label, list(m ORDER BY pos) AS c
         FROM (SELECT label, pos, avg(x) AS m FROM cells GROUP BY label, pos) GROUP BY label),
whole AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM cells GROUP BY pos))"""
SCORED = f"""{CENT}, {mapping_sql('emb', 4)},
classes AS (
    SELECT subset_id, pos, label, c FROM mapping JOIN cent USING (label)
    UNION ALL
    SELECT subset_id, count(*), '__NOISE__', (SELECT c FROM whole) FROM mapping GROUP BY subset_id),
logits AS (
    SELECT row_id, subset_id, pos, classes.label,
           10 * list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS z
    FROM emb, classes),
expd AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id, subset_id)) AS e FROM logits),
probs AS (SELECT row_id, subset_id, pos, label, e / sum(e) OVER (PARTITION BY row_id, subset_id) AS p FROM expd),
preds AS (
    SELECT row_id, subset_id, arg_max(label, p) AS predicted_label,
           round(-sum(p * log2(p)), 9) AS uncertainty, round(max(p), 9) AS max_probability
    FROM probs GROUP BY row_id, subset_id)"""
PAIRS = f"""{SCORED},
pairs AS (SELECT row_id, subset_id, predicted_label, emb.label AS true_label FROM preds JOIN emb USING (row_id))"""

REPLIES = f"""{DOCS}, replies AS (
    SELECT row_id, text, label, lang, quality IS NULL AS cached,
           CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN ' True.' || chr(10)
                WHEN quality = 0 THEN 'FALSE' ELSE 'true or false, indeterminate' END AS reply
    FROM docs LEFT JOIN labels ON labels.doc_id = docs.row_id)"""
VERDICTS = f"""{REPLIES}, verdicts AS (
    SELECT *, coalesce(contains(lower(reply), 'true') AND NOT contains(lower(reply), 'false'), false) AS is_valid,
           CASE WHEN reply IS NULL THEN 0.0
                WHEN contains(lower(reply), 'true') <> contains(lower(reply), 'false') THEN 0.8 ELSE 0.3 END AS confidence
    FROM replies)"""
RUNS = f"""{VERDICTS}, runs AS (
    SELECT *, label AS run, CAST(floor(row_id * 10 / (SELECT max(doc_id) + 1 FROM documents)) + 1 AS INTEGER) AS iteration
    FROM verdicts)"""
HISTORY = f"""{RUNS}, history AS (
    SELECT run, iteration, count(*) AS batch_size,
           count(*) FILTER (lang = 'fr') AS predictions_made,
           count(*) FILTER (lang = 'fr' AND is_valid) AS validated_samples,
           sum(length(text)) / 1000 AS iteration_time,
           coalesce(count(*) FILTER (lang = 'fr' AND is_valid) / nullif(count(*) FILTER (lang = 'fr'), 0), 0.0) AS validation_rate
    FROM runs GROUP BY run, iteration)"""
