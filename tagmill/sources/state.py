"""Tables of a run: state per iteration, models, caches, vectors, mapping.

Everything is append-only; an iteration counts once its manifest is written, which
happens last.
"""

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.operators.mapping import flat_mapping, nested_mapping
from tagmill.operators.models import coefficient_table

MANIFEST = "iteration int, name string, rows long"


def exists(spark: SparkSession, pattern: str) -> bool:
    """True when some path matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _folder(run_dir: str, iteration: int) -> str:
    return f"{run_dir}/state/iter={iteration}"


def save_state(run_dir: str, iteration: int, **tables: DataFrame) -> DataFrame:
    """Write the tables of one iteration, then its manifest."""
    rows = []
    spark = None
    for name, table in tables.items():
        spark = table.sparkSession
        path = f"{_folder(run_dir, iteration)}/{name}"
        table.write.mode("overwrite").parquet(path)
        rows.append((iteration, name, spark.read.schema(table.schema).parquet(path).count()))
    manifest = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{run_dir}/manifest/iter={iteration}/table")
    return spark.read.schema(MANIFEST).parquet(f"{run_dir}/manifest/iter={iteration}/table")


def latest_iteration(spark: SparkSession, run_dir: str):
    """Highest complete iteration, or None."""
    pattern = f"{run_dir}/manifest/iter=*/table"
    if not exists(spark, f"{pattern}/_SUCCESS"):
        return None
    found = spark.read.schema(MANIFEST).parquet(pattern)
    return found.agg(F.max("iteration")).first()[0]


def load_state(spark: SparkSession, run_dir: str, iteration: int | None = None):
    """Tables of an iteration, by default the latest complete one."""
    at = latest_iteration(spark, run_dir) if iteration is None else iteration
    if at is None:
        raise FileNotFoundError(f"no complete state under {run_dir}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{run_dir}/manifest/iter={at}/table")
    names = [r["name"] for r in manifest.select("name").collect()]
    return at, {name: spark.read.parquet(f"{_folder(run_dir, at)}/{name}") for name in names}


def append_rows(rows: DataFrame, run_dir: str, name: str, iteration: int) -> None:
    """Add the rows of one iteration to a growing table; a repeated run of the same
    iteration replaces its own rows only."""
    rows.write.mode("overwrite").parquet(f"{run_dir}/{name}/iteration={iteration}")


def read_appended(spark: SparkSession, run_dir: str, name: str, schema, upto: int | None = None) -> DataFrame:
    """All rows of a growing table with their iteration; empty before the first write."""
    if exists(spark, f"{run_dir}/{name}/iteration=*"):
        table = spark.read.schema(schema).option("basePath", f"{run_dir}/{name}").parquet(f"{run_dir}/{name}/iteration=*")
    else:
        table = spark.createDataFrame([], schema).withColumn("iteration", F.lit(0))
    return table if upto is None else table.where(F.col("iteration") <= upto)


def save_mapping(mapping: DataFrame, path: str) -> None:
    """Parquet table of the mapping and a JSON form of it, one line per subset."""
    mapping.write.parquet(f"{path}/table")
    nested_mapping(mapping).select("subset_id", "labels").write.json(f"{path}/json")


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def load_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """Mapping from its JSON form."""
    return flat_mapping(spark.read.schema("subset_id string, labels array<string>").json(f"{path}/json"))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Append ``key, model, embedding`` rows, one folder per model."""
    vectors.write.mode("append").partitionBy("model").parquet(path)


def load_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Saved vectors; a model filter prunes to its folder."""
    table = spark.read.parquet(path)
    return table if model is None else table.where(F.col("model") == model)


def save_cache(cache: DataFrame, path: str) -> None:
    """Append cache rows."""
    cache.write.mode("append").parquet(path)


def load_cache(spark: SparkSession, path: str, keys, schema=None) -> DataFrame:
    """Cache rows, one per key; empty when nothing was saved."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.parquet(path)
    return table.dropDuplicates(list(keys))


def save_models(
    spark: SparkSession, models, path: str, kind: str, weights: DataFrame | None = None, vocabulary: DataFrame | None = None
) -> DataFrame:
    """Save the models of all subsets, the vocabularies that they may have and an index of them.

    Linear models are their coefficient table; others use MLlib's own format.
    """
    if vocabulary is not None:
        vocabulary.write.parquet(f"{path}/vocabulary")
    if kind == "logistic_regression":
        (coefficient_table(spark, models) if weights is None else weights).write.parquet(f"{path}/coefficients")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "label"))), lambda x: x["label"])
        table = spark.read.parquet(f"{path}/coefficients").groupBy("subset_id").agg(ordered.alias("labels"))
        index = table.select("subset_id", F.lit(kind).alias("kind"), F.lit(f"{path}/coefficients").alias("folder"), "labels")
    else:
        rows = []
        for at, (subset_id, (model, labels)) in enumerate(sorted(models.items())):
            model.write().save(f"{path}/model_{at}")
            rows.append((subset_id, kind, f"{path}/model_{at}", labels))
        index = spark.createDataFrame(rows, "subset_id string, kind string, folder string, labels array<string>")
    index.coalesce(1).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame | None:
    """Vocabularies saved with the models, if they have any."""
    return spark.read.parquet(f"{path}/vocabulary") if exists(spark, f"{path}/vocabulary") else None


def load_models(spark: SparkSession, path: str):
    """Saved models: a dictionary by subset, or the coefficient table of linear ones."""
    rows = spark.read.parquet(f"{path}/index").collect()
    if all(r["kind"] == "logistic_regression" for r in rows):
        return {}, spark.read.parquet(f"{path}/coefficients")
    return {r["subset_id"]: (RandomForestClassificationModel.load(r["folder"]), r["labels"]) for r in rows}, None
