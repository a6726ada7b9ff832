"""Sources, sinks, cleaning, joins, statistics, sets and sampling."""

from pyspark.sql import functions as F

from suite.fixtures import *  # noqa: F403
from suite.fixtures import table
from suite.registry import query
from tagmill.constants import NOISE_LABEL
from tagmill.functions.replies import verdict
from tagmill.functions.text import text_key
from tagmill.operators import cleaning, features, judge, mapping as maps, sampling, stats
from tagmill.operators.labelspace import centroids
from tagmill.operators.neighbours import similar_pairs
from tagmill.sources import files, state
from tagmill.storage import fresh_path, lookup_join, settle


# sources


@query(f"WITH {SEED} SELECT text, label FROM seed")
def scan_csv_labeled(spark, sf):
    path = fresh_path(spark, "csv")
    files.write_csv(seed(spark, sf).select("text", "label"), path)
    return files.read_csv(spark, path, columns=["text", "label"], multi_line=True)


@query(f"""WITH {BASE} SELECT 'labelled' AS kind, text, label FROM seed
UNION ALL SELECT 'pool', text, NULL FROM pool""")
def scan_json(spark, sf):
    path = fresh_path(spark, "json")
    files.write_json(seed(spark, sf).select("text", "label"), f"{path}/labelled")
    as_object = F.to_json(F.struct("text"))
    as_string = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    mixed = pool(spark, sf).select(F.when(F.col("row_id") % 2 == 0, as_object).otherwise(as_string).alias("value"))
    mixed.write.text(f"{path}/pool")
    labelled = files.read_json(spark, f"{path}/labelled").select(F.lit("labelled").alias("kind"), "text", "label")
    unlabelled = files.read_pool_json(spark, f"{path}/pool")
    return labelled.unionByName(
        unlabelled.select(F.lit("pool").alias("kind"), "text", F.lit(None).cast("string").alias("label"))
    )


@query(f"""SELECT text FROM (
SELECT regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS text
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE text <> ''""")
def scan_text_lines(spark, sf):
    path = fresh_path(spark, "lines")
    documents(spark, sf).select("text").write.text(path)
    return files.read_lines(spark, path)


@query("SELECT doc_id AS row_id, text FROM documents ORDER BY doc_id LIMIT 500")
def scan_limit(spark, sf):
    return files.first_rows(documents(spark, sf).select("row_id", "text"), 500)


def saved_vectors(spark, sf):
    """The vector table saved under two model names, loaded for one."""
    path = fresh_path(spark, "vectors")
    rows = table(spark, sf, "embeddings")
    for model in ("given", "other"):
        state.save_vectors(
            rows.select(F.md5(F.col("vec_id").cast("string")).alias("key"), F.lit(model).alias("model"), "embedding"), path
        )
    return path


@query("""SELECT md5(vec_id::VARCHAR) AS key, 'given' AS model, unnest(embedding)::DOUBLE AS value,
generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings""")
def scan_vectors(spark, sf):
    loaded = state.load_vectors(spark, saved_vectors(spark, sf), "given")
    return loaded.select("key", "model", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


# sinks


@query("SELECT p_partkey AS row_id, p_name AS text, p_brand AS label FROM part")
def sink_csv(spark, sf):
    path = fresh_path(spark, "csv")
    files.write_rows(parts(spark, sf), path, "csv")
    return spark.read.schema("row_id long, text string, label string").options(**files.CSV).csv(path)


@query("SELECT conv_id, turn, role, text FROM conversations")
def sink_json(spark, sf):
    path = fresh_path(spark, "json")
    files.write_rows(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path, "json")
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query(f"WITH {BASE} SELECT text, label FROM seed UNION ALL SELECT text, label FROM validated")
def export_training(spark, sf):
    path = fresh_path(spark, "export")
    files.export_training(seed(spark, sf), validated(spark, sf), path)
    return files.read_csv(spark, path, columns=["text", "label"], multi_line=True)


def _saved_state(spark, sf):
    run_dir = fresh_path(spark, "run")
    state.save_state(run_dir, 1, seed=seed(spark, sf), mapping=mapping(spark, sf))
    manifest = state.save_state(
        run_dir, 2, seed=seed(spark, sf), validated=validated(spark, sf), mapping=mapping(spark, sf)
    )
    return run_dir, manifest


@query(f"""WITH {BASE}, {MAPPING} SELECT 2 AS iteration, 'seed' AS name, count(*) AS rows FROM seed
UNION ALL SELECT 2, 'validated', count(*) FROM validated UNION ALL SELECT 2, 'mapping', count(*) FROM mapping""")
def save_state(spark, sf):
    return _saved_state(spark, sf)[1]


@query(f"""WITH {BASE} SELECT 2 AS iteration, 'seed' AS name, row_id, text, label FROM seed
UNION ALL SELECT 2, 'validated', row_id, text, label FROM validated""")
def load_state(spark, sf):
    at, tables = state.load_state(spark, _saved_state(spark, sf)[0])
    both = tables["seed"].withColumn("name", F.lit("seed")).unionByName(
        tables["validated"].withColumn("name", F.lit("validated"))
    )
    return both.withColumn("iteration", F.lit(at))


@query(f"WITH {DOCS}, {MAPPING} SELECT subset_id, pos, label FROM mapping")
def save_mapping(spark, sf):
    path = fresh_path(spark, "mapping")
    state.save_mapping(mapping(spark, sf), path)
    return state.load_mapping_json(spark, path).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT model, count(*) AS n, count(DISTINCT md5(vec_id::VARCHAR)) AS keys, sum(len(embedding)) AS cells
FROM embeddings, (VALUES ('given'), ('other')) AS m(model) GROUP BY model""")
def save_vectors(spark, sf):
    loaded = state.load_vectors(spark, saved_vectors(spark, sf))
    return loaded.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.sum(F.size("embedding")).alias("cells")
    )


def verdict_rows(spark, sf):
    """Verdict per document, as a judge would log it."""
    rows = replies(spark, sf).withColumn("_v", verdict(F.col("reply")))
    error = F.when(F.col("reply").isNull(), F.lit("request failed"))
    return rows.select("row_id", "text", "label", "lang", "reply", "cached", "_v.*", error.alias("error"))


def verdict_cache(spark, sf):
    """Cache rows of all judged documents whose request did not fail."""
    rows = verdict_rows(spark, sf).where("NOT cached AND error IS NULL")
    return rows.select(
        text_key(F.col("text")).alias("text_md5"),
        F.col("label").alias("predicted_label"),
        "is_valid",
        "confidence",
        "reply",
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("n_examples"),
        F.lit("").alias("description"),
    )


CACHE = f"""{VERDICTS}, cache AS (
    SELECT DISTINCT md5(text) AS text_md5, label AS predicted_label FROM verdicts WHERE NOT cached AND reply IS NOT NULL)"""


@query(f"WITH {VERDICTS} SELECT md5(text) AS text_md5, label AS predicted_label, is_valid, confidence FROM verdicts "
       "WHERE NOT cached AND reply IS NOT NULL")
def save_cache(spark, sf):
    path = fresh_path(spark, "cache")
    state.save_cache(verdict_cache(spark, sf), path)
    return spark.read.parquet(path).select("text_md5", "predicted_label", "is_valid", "confidence")


@query(f"WITH {CACHE} SELECT text_md5, predicted_label FROM cache")
def load_cache(spark, sf):
    """Verdicts added twice, merged, added once more and looked up for all documents."""
    cache = judge.verdict_cache(fresh_path(spark, "cache"))
    cache.add(verdict_cache(spark, sf), 1)
    cache.add(verdict_cache(spark, sf), 2)
    cache.compact(spark)
    cache.add(verdict_cache(spark, sf), 3)
    pairs = judge.keyed(documents(spark, sf)).withColumnRenamed("label", "predicted_label")
    return cache.found(pairs).select(*judge.PAIR)


# projections and filters


@query(f"""WITH dirty AS (
  SELECT doc_id AS row_id,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN chr(8195) || chr(10)
         ELSE chr(8195) || chr(10) || text || ' ' || chr(31) END AS text,
    CASE WHEN doc_id % 7 = 0 THEN chr(160) || ' ' ELSE chr(9) || source || chr(8232) END AS label
  FROM documents),
stripped AS (SELECT row_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text,
                    regexp_replace(label, '^{SPACE}+|{SPACE}+$', '', 'g') AS label FROM dirty)
SELECT row_id, text, label, CASE WHEN coalesce(text, '') = '' THEN 'text' WHEN label = '' THEN 'label' ELSE 'kept' END AS status
FROM stripped""")
def clean_rows(spark, sf):
    wide, lines = F.lit(" \n"), F.lit(" ")
    text = (
        F.when(F.col("row_id") % 13 == 0, F.lit(None).cast("string"))
        .when(F.col("row_id") % 11 == 0, wide)
        .otherwise(F.concat(wide, F.col("text"), F.lit(" \x1f")))
    )
    label = F.when(F.col("row_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("\t"), F.col("label"), lines))
    kept, rejected = cleaning.clean_rows(documents(spark, sf).select("row_id", text.alias("text"), label.alias("label")))
    return kept.withColumn("status", F.lit("kept")).unionByName(rejected.withColumnRenamed("rejected", "status"))


@query("SELECT p_name AS text, p_type AS label FROM part")
def project_column(spark, sf):
    return cleaning.project_columns(table(spark, sf, "part"), "p_name", "p_type")


@query("SELECT doc_id AS row_id, text, source AS label, lang FROM documents WHERE source = 'src3'")
def filter_label(spark, sf):
    return cleaning.of_label(documents(spark, sf), "src3")


@query(f"WITH {SCORED} SELECT row_id, subset_id, predicted_label, uncertainty FROM preds WHERE predicted_label <> '__NOISE__'")
def drop_noise_predictions(spark, sf):
    return cleaning.drop_noise(predictions(spark, sf)).select("row_id", "subset_id", "predicted_label", "uncertainty")


@query(f"WITH {VERDICTS} SELECT row_id, label, confidence FROM verdicts WHERE is_valid AND confidence >= 0.5")
def filter_confidence(spark, sf):
    return cleaning.accepted(verdict_rows(spark, sf), 0.5).select("row_id", "label", "confidence")


@query(f"""WITH {CENT}, s AS (SELECT row_id, cent.label, round(list_cosine_similarity(v, c), 9) AS similarity FROM emb, cent)
SELECT row_id, label, similarity FROM s WHERE similarity >= 0.1""")
def filter_similarity(spark, sf):
    rows = vectors(spark, sf).select("row_id", "vector")
    around = centroids(vectors(spark, sf), "label")
    queries, items = rows.withColumnRenamed("row_id", "query_id"), around.withColumnRenamed("label", "item_id")
    found = similar_pairs(queries, items, 0.1)
    return found.select(F.col("query_id").alias("row_id"), F.col("item_id").alias("label"), "similarity")


@query(f"""WITH {PARTS} SELECT row_id, label FROM parts
WHERE label IN (SELECT label FROM parts GROUP BY label HAVING count(*) >= 80)""")
def filter_min_class_count(spark, sf):
    return cleaning.with_min_class_count(parts(spark, sf), 80).select("row_id", "label")


CLASSES = """classes AS (SELECT subset_id, pos AS class_idx, label FROM mapping
    UNION ALL SELECT subset_id, count(*), '__NOISE__' FROM mapping GROUP BY subset_id)"""
MARKED = """marked AS (SELECT row_id, 'subset_' || (row_id % 3) AS subset_id,
    CASE WHEN row_id % 5 = 0 THEN '__NOISE__' ELSE label END AS label FROM docs)"""


def _marked(spark, sf):
    subset = F.concat(F.lit("subset_"), (F.col("row_id") % 3).cast("string"))
    label = F.when(F.col("row_id") % 5 == 0, F.lit(NOISE_LABEL)).otherwise(F.col("label"))
    return documents(spark, sf).select("row_id", subset.alias("subset_id"), label.alias("label"))


@query(f"WITH {DOCS}, {MAPPING}, {CLASSES}, {MARKED} SELECT row_id, subset_id, label, class_idx FROM marked JOIN classes USING (subset_id, label)")
def label_to_index(spark, sf):
    return maps.to_index(_marked(spark, sf), mapping(spark, sf))


@query(f"""WITH {DOCS}, {MAPPING}, {CLASSES}
SELECT row_id, subset_id, class_idx, label FROM (SELECT row_id, 'subset_' || (row_id % 3) AS subset_id, row_id % 9 AS class_idx FROM docs)
JOIN classes USING (subset_id, class_idx)""")
def index_to_label(spark, sf):
    subset = F.concat(F.lit("subset_"), (F.col("row_id") % 3).cast("string"))
    rows = documents(spark, sf).select("row_id", subset.alias("subset_id"), (F.col("row_id") % 9).cast("int").alias("class_idx"))
    return maps.to_label(rows, mapping(spark, sf))


# joins


@query(f"WITH {DOCS}, {MAPPING} SELECT row_id, label, subset_id FROM docs JOIN mapping USING (label)")
def label_to_subset(spark, sf):
    return maps.attach_subset(documents(spark, sf).select("row_id", "label"), mapping(spark, sf))


@query(f"""WITH {BASE}, {MAPPING} SELECT row_id, text, label, subset_id
FROM (SELECT * FROM seed UNION ALL SELECT * FROM validated) JOIN mapping USING (label)""")
def subset_data(spark, sf):
    return maps.subset_rows(seed(spark, sf), validated(spark, sf), mapping(spark, sf))


CANDIDATES = f"""{PARTS}, {PART_MAPPING}, homes AS (SELECT parts.*, m.subset_id AS home FROM parts LEFT JOIN mapping m USING (label)),
ranked AS (
  SELECT row_id, label, s.subset_id,
         row_number() OVER (PARTITION BY s.subset_id ORDER BY md5('42:' || row_id), row_id) AS place
  FROM homes, (SELECT DISTINCT subset_id FROM mapping) s WHERE home IS DISTINCT FROM s.subset_id),
candidates AS (SELECT * FROM ranked WHERE place <= 1000)"""


@query(f"WITH {CANDIDATES} SELECT row_id, label, subset_id, place FROM candidates")
def noise_candidates(spark, sf):
    return maps.noise_candidates(parts(spark, sf).select("row_id", "label"), part_mapping(spark, sf))


@query(f"""WITH {DOCS}, {MAPPING}, {CLASSES}, {MARKED}
SELECT row_id, subset_id, label FROM marked WHERE (subset_id, label) IN (SELECT (subset_id, label) FROM classes)""")
def train_membership(spark, sf):
    return maps.membership(_marked(spark, sf), mapping(spark, sf))


LABELLED = "labelled AS (SELECT 0 AS src, * FROM seed UNION ALL SELECT 1, * FROM validated)"


@query(f"""WITH {BASE}, {LABELLED}, firsts AS (
  SELECT text, label FROM labelled QUALIFY row_number() OVER (PARTITION BY text ORDER BY src, row_id) = 1)
SELECT docs.row_id, md5(docs.text) AS text_md5, firsts.label FROM docs LEFT JOIN firsts USING (text)""")
def lookup_label_by_text(spark, sf):
    labelled = seed(spark, sf).withColumn("src", F.lit(0)).unionByName(validated(spark, sf).withColumn("src", F.lit(1)))
    found = maps.label_by_text(documents(spark, sf).select("row_id", "text"), labelled)
    return found.select("row_id", "text_md5", "label")


@query(f"""WITH {EMB}, firsts AS (SELECT label, arg_min(v, row_id) AS v FROM emb GROUP BY label),
named AS (SELECT v, min(label) AS label FROM firsts GROUP BY v)
SELECT row_id, named.label FROM emb LEFT JOIN named USING (v)""")
def lookup_label_by_vector(spark, sf):
    rows = vectors(spark, sf)
    firsts = rows.groupBy("label").agg(F.min_by("vector", "row_id").alias("vector"))
    return maps.label_by_vector(rows.select("row_id", "vector"), firsts).select("row_id", "label")


@query(f"WITH {BASE} SELECT row_id, text, label, lang FROM docs WHERE row_id NOT IN (SELECT row_id FROM seed)")
def holdout_anti(spark, sf):
    return maps.holdout(documents(spark, sf), seed(spark, sf))


def text_cache(spark, sf):
    """Vectors of the seed texts."""
    rows = seed(spark, sf)
    empty = spark.createDataFrame([], features.EMPTY_CACHE)
    misses = features.cache_misses(rows, empty, "words")
    return settle(features.encode_texts(misses, features.word_hash_encoder(), "words"), "cache")


@query(f"WITH {BASE} SELECT DISTINCT md5(text) AS key, text FROM docs WHERE md5(text) NOT IN (SELECT md5(text) FROM seed)")
def embedding_cache_miss(spark, sf):
    return features.cache_misses(documents(spark, sf), text_cache(spark, sf), "words")


WORD_VECTORS = r"""words AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM keyed),
sums AS (SELECT key, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos,
                sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS s FROM words GROUP BY 1, 2),
grid AS (SELECT key, p.pos, coalesce(s, 0) AS s FROM keyed CROSS JOIN (SELECT range AS pos FROM range(64)) p LEFT JOIN sums USING (key, pos)),
sized AS (SELECT key, pos, s, sqrt(sum(s * s) OVER (PARTITION BY key)) AS n FROM grid),
cells AS (SELECT key, pos, (CASE WHEN n > 0 THEN s / n ELSE 0 END)::FLOAT::DOUBLE AS value FROM sized)"""


@query(f"""WITH {BASE}, keyed AS (SELECT DISTINCT md5(text) AS key, text FROM seed), {WORD_VECTORS}
SELECT row_id, md5(text) AS key, pos, value FROM docs JOIN cells ON cells.key = md5(docs.text)""")
def embedding_cache_hit(spark, sf):
    hits = features.cache_hits(documents(spark, sf).select("row_id", "text"), text_cache(spark, sf), "words")
    return hits.select("row_id", "key", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query(f"""WITH {VERDICTS}, known AS (SELECT DISTINCT md5(text) AS text_md5, label FROM verdicts WHERE NOT cached AND reply IS NOT NULL)
SELECT row_id, md5(text) AS text_md5, verdicts.label AS predicted_label, known.label IS NOT NULL AS cached
FROM verdicts LEFT JOIN known ON known.text_md5 = md5(text) AND known.label = verdicts.label""")
def validation_cache_split(spark, sf):
    rows = documents(spark, sf).select("row_id", "text", F.col("label").alias("predicted_label"))
    return judge.cache_split(rows, verdict_cache(spark, sf)).select("row_id", "text_md5", "predicted_label", "cached")


# statistics


@query(f"WITH {BASE} SELECT label, count(*) AS n FROM seed GROUP BY label")
def label_distribution(spark, sf):
    return stats.label_distribution(seed(spark, sf))


@query(f"""WITH {BASE}, c AS (SELECT label, count(*) AS n FROM seed GROUP BY label)
SELECT sum(n)::BIGINT AS total_samples, count(*) AS unique_labels, avg(n) AS avg_samples_per_label,
min(n) AS min_samples_per_label, max(n) AS max_samples_per_label FROM c""")
def seed_stats(spark, sf):
    return stats.seed_stats(seed(spark, sf))


@query(f"""WITH {BASE} SELECT 'seed' AS src, count(*) AS samples, count(DISTINCT label) AS unique_labels FROM seed
UNION ALL SELECT 'validated', count(*), count(DISTINCT label) FROM validated
UNION ALL SELECT 'labelled', count(*), count(DISTINCT label) FROM (SELECT label FROM seed UNION ALL SELECT label FROM validated)
UNION ALL SELECT 'pool', count(*), NULL FROM pool""")
def data_statistics(spark, sf):
    return stats.data_statistics(seed(spark, sf), validated(spark, sf), pool(spark, sf))


@query("SELECT DISTINCT source AS label FROM documents")
def distinct_labels(spark, sf):
    return stats.distinct_labels(documents(spark, sf))


@query(f"""WITH {PARTS}, c AS (SELECT label, count(*) AS n FROM parts GROUP BY label),
top AS (SELECT label, n FROM c ORDER BY n DESC, label LIMIT 20)
SELECT top.label, top.n, s.* FROM top, (SELECT count(*) AS classes, min(n) AS min_size, max(n) AS max_size,
avg(n) AS mean_size, median(n) AS median_size FROM c) s""")
def class_size_stats(spark, sf):
    rows = parts(spark, sf)
    return pair_with(stats.top_classes(rows, 20), stats.class_size_stats(rows), "classes")


@query(f"""WITH {PARTS}, {PART_MAPPING}, s AS (SELECT subset_id, count(*) AS n FROM mapping GROUP BY subset_id)
SELECT count(*) AS num_subsets, sum(n)::BIGINT AS total_labels, avg(n) AS avg_subset_size,
min(n) AS min_subset_size, max(n) AS max_subset_size FROM s""")
def subset_stats(spark, sf):
    return stats.subset_stats(part_mapping(spark, sf))


@query(f"WITH {BASE} SELECT label, row_id, text FROM seed")
def group_texts_by_label(spark, sf):
    """Texts grouped by label as a table with one folder per label."""
    return stats.group_texts(seed(spark, sf), fresh_path(spark, "grouped")).select("label", "row_id", "text")


@query(f"""WITH {CENT} SELECT label, unnest(range(1, 65)) - 1 AS pos, round(unnest(c), 9) AS value FROM cent""")
def centroid(spark, sf):
    means = centroids(vectors(spark, sf), "label")
    return means.select("label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 9))


TYPE_MAPPING = """names AS (SELECT label FROM typed UNION SELECT 'NO SUCH ' || label FROM typed WHERE label LIKE 'ECO%'),
mapping AS (SELECT 'subset_' || ((row_number() OVER (ORDER BY label) - 1) // 8) AS subset_id, label FROM names)"""


@query(f"""WITH typed AS (SELECT p_partkey AS row_id, p_type || ' ' || p_size AS label FROM part), {TYPE_MAPPING},
c AS (SELECT label, count(*) AS n FROM typed GROUP BY label)
SELECT subset_id, round(avg(n), 9) AS avg_present, round(avg(coalesce(n, 0)), 9) AS avg_all
FROM mapping LEFT JOIN c USING (label) GROUP BY subset_id""")
def avg_samples_per_class(spark, sf):
    """Parts by type; some mapped labels have no rows."""
    rows = typed(spark, sf)
    labels = rows.select("label").distinct()
    absent = labels.where("label LIKE 'ECO%'").select(F.concat(F.lit("NO SUCH "), "label").alias("label"))
    found = maps.class_averages(rows, maps.fixed_mapping(labels.unionByName(absent), 8))
    return found.select("subset_id", F.round("avg_present", 9).alias("avg_present"), F.round("avg_all", 9).alias("avg_all"))


@query(f"""WITH {PARTS}, {PART_MAPPING} SELECT (SELECT count(DISTINCT subset_id) FROM mapping) AS num_subsets,
(SELECT count(*) FROM mapping) AS total_labels, (SELECT count(DISTINCT subset_id) FROM parts JOIN mapping USING (label)) AS num_classifiers""")
def components_info(spark, sf):
    known = part_mapping(spark, sf)
    fitted = maps.attach_subset(parts(spark, sf), known).select("subset_id").distinct()
    return stats.components_info(known, fitted)


@query("""SELECT model, count(*) AS cached_embeddings, max(len(embedding)) AS dimension
FROM embeddings, (VALUES ('given'), ('other')) AS m(model) GROUP BY model""")
def cache_stats(spark, sf):
    return stats.cache_stats(state.load_vectors(spark, saved_vectors(spark, sf)))


# sets


@query(f"WITH {BASE} SELECT row_id, text, label, 'seed' AS src FROM seed UNION ALL SELECT row_id, text, label, 'validated' FROM validated")
def union_seed_validated(spark, sf):
    return maps.union_labelled(seed(spark, sf), validated(spark, sf))


@query(f"WITH {PAIRS} SELECT true_label AS label FROM pairs UNION SELECT predicted_label FROM pairs")
def union_true_pred_labels(spark, sf):
    from tagmill.operators.evaluate import all_labels

    return all_labels(pairs(spark, sf))


@query(f"""WITH {BASE}, drawn AS (SELECT row_id FROM docs
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) <= 30)
SELECT row_id, label FROM docs WHERE row_id NOT IN (SELECT row_id FROM drawn)""")
def train_minus(spark, sf):
    rows = documents(spark, sf).select("row_id", "label")
    return maps.holdout(rows, sampling.take_lowest(rows, ["label"], ["row_id"], 30))


VALIDATED_SCHEMA = "row_id long, text string, label string, confidence double, source string"


def appended(spark, sf):
    """Validated rows written in two iterations, one of them twice."""
    run_dir = fresh_path(spark, "run")
    rows = validated(spark, sf).withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("judge"))
    for at in (1, 2, 2):
        state.append_rows(rows.where(F.col("row_id") % 2 == at - 1), run_dir, "validated", at)
    return run_dir


@query(f"WITH {BASE} SELECT row_id, text, label, 1.0::DOUBLE AS confidence, 'judge' AS source, CAST(row_id % 2 + 1 AS INTEGER) AS iteration FROM validated")
def append_validated(spark, sf):
    return state.read_appended(spark, appended(spark, sf), "validated", VALIDATED_SCHEMA)


@query(f"WITH {BASE} SELECT 'cleared' AS run, 0 AS n UNION ALL SELECT 'kept', count(*) FROM validated")
def clear_validated(spark, sf):
    """A new run folder has no validated rows; the old one keeps its own."""
    old, new = appended(spark, sf), fresh_path(spark, "run")

    def count(run_dir, name):
        rows = state.read_appended(spark, run_dir, "validated", VALIDATED_SCHEMA)
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("run"), "n")

    return count(new, "cleared").unionByName(count(old, "kept"))


# positions and sampling


@query("""SELECT row_id, position, position // 100 AS batch FROM (
SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS position
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def batch_slice(spark, sf):
    """Every batch of the pool, by position."""
    numbered = sampling.number_rows(pool(spark, sf).select("row_id"), "row_id")
    return numbered.withColumn("batch", F.floor(F.col("position") / 100))


def _draw(by, n):
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('42:' || row_id), row_id) <= {n}"


@query(f"""WITH {BASE}, {LABELLED}
SELECT row_id, label, text, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS place
FROM labelled QUALIFY place <= 10""")
def sample_examples_per_label(spark, sf):
    labelled = seed(spark, sf).unionByName(validated(spark, sf))
    return sampling.sample_examples(labelled, 10)


TYPES = "typed AS (SELECT p_partkey AS row_id, p_type || ' ' || p_size AS label FROM part)"


def typed(spark, sf):
    """Parts by type and size: more classes than the fallback keeps, of uneven size."""
    label = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), label.alias("label"))


@query(f"WITH {TYPES} SELECT label, count(*) AS n, 'largest' AS rule FROM typed GROUP BY label ORDER BY n DESC, label LIMIT 50")
def top_classes_fallback(spark, sf):
    return sampling.large_classes(typed(spark, sf), 10**9, 50)


LARGE_TYPES = f"""{TYPES}, sizes AS (SELECT label, count(*) AS n FROM typed GROUP BY label),
middle AS (SELECT median(n)::BIGINT AS m FROM sizes)"""


@query(f"""WITH {LARGE_TYPES} SELECT row_id, label,
row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) <= (SELECT m FROM middle) AS is_train
FROM typed WHERE label IN (SELECT label FROM sizes, middle WHERE n >= m)""")
def stratified_train_pool_split(spark, sf):
    """As many training rows per class as half of the classes have; smaller classes drop out."""
    rows = settle(typed(spark, sf), "typed")
    middle = rows.groupBy("label").count().agg(F.median("count").cast("decimal(20, 1)")).first()[0]
    return sampling.train_pool_split(rows, int(middle.to_integral_value("ROUND_HALF_EVEN")), 50)


@query(f"""WITH {PARTS} SELECT row_id, label,
row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id)
 <= CASE WHEN count(*) OVER (PARTITION BY label) < 2 THEN 1 ELSE (count(*) OVER (PARTITION BY label) * 80 + 50) // 100 END AS is_train
FROM parts""")
def stratified_fraction_split(spark, sf):
    return sampling.fraction_split(parts(spark, sf).select("row_id", "label"), ["label"], ["row_id"])


@query(f"WITH {PARTS} SELECT row_id, label FROM parts QUALIFY {_draw('', 700)}")
def sample_rows(spark, sf):
    return sampling.sample_rows(parts(spark, sf).select("row_id", "label"), 700)


TARGETS = """targets AS (SELECT subset_id, floor(coalesce(avg(n), 1) * 2)::BIGINT AS target
FROM mapping LEFT JOIN (SELECT label, count(*) AS n FROM parts GROUP BY label) USING (label) GROUP BY subset_id)"""


@query(f"WITH {PARTS}, {PART_MAPPING}, {TARGETS} SELECT subset_id, target FROM targets")
def noise_target(spark, sf):
    return maps.noise_targets(parts(spark, sf), part_mapping(spark, sf))


def oversampled_sql(times):
    """Candidates in turn, again and again, until ``times`` the target is reached."""
    return f"""{CANDIDATES}, {TARGETS}, sized AS (SELECT subset_id, count(*) AS m FROM candidates GROUP BY subset_id),
repeated AS (
  SELECT row_id, subset_id, place, m, target * {times} AS wanted, unnest(range(0, CAST(ceil(target * {times} / m) AS BIGINT))) AS rep
  FROM candidates JOIN sized USING (subset_id) JOIN targets USING (subset_id)),
oversampled AS (SELECT row_id, subset_id, rep + 1 AS copy FROM repeated WHERE rep * m + place <= wanted)"""


@query(f"WITH {oversampled_sql(20)} SELECT row_id, subset_id, copy FROM oversampled")
def noise_oversample(spark, sf):
    """Twenty times the usual target, so that candidates repeat."""
    known = part_mapping(spark, sf)
    rows = parts(spark, sf).select("row_id", "label")
    targets = maps.noise_targets(rows, known, 2.0).withColumn("target", F.col("target") * 20)
    return maps.oversample_noise(maps.noise_candidates(rows, known), targets).select("row_id", "subset_id", "copy")


@query(f"""WITH {oversampled_sql(1)} SELECT row_id, label, subset_id, 0 AS copy FROM parts JOIN mapping USING (label)
UNION ALL SELECT row_id, '__NOISE__', subset_id, copy FROM oversampled""")
def training_with_noise(spark, sf):
    rows = parts(spark, sf).select("row_id", "label")
    return maps.training_with_noise(rows, part_mapping(spark, sf))


@query(f"""WITH {PARTS}, sizes AS (SELECT * FROM (VALUES (30), (50), (100)) AS s(per_class)),
c AS (SELECT label, count(*) AS n FROM parts GROUP BY label),
chosen AS (SELECT per_class, label FROM sizes, c WHERE n >= per_class
  UNION ALL SELECT per_class, label FROM sizes, (SELECT label FROM c ORDER BY n DESC, label LIMIT 50)
  WHERE per_class > (SELECT max(n) FROM c)),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS k FROM parts)
SELECT row_id, label, per_class, CASE WHEN k <= per_class THEN 'train' ELSE 'pool' END AS role FROM r JOIN chosen USING (label)""")
def experiment_splits(spark, sf):
    return sampling.experiment_splits(parts(spark, sf).select("row_id", "label"), 50)
