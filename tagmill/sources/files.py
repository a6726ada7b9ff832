"""Text files in and out. Readers never infer types."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.text import strip_space

CSV = {"header": True, "escape": '"'}


def read_csv(
    spark: SparkSession,
    path: str,
    text: str = "text",
    label: str | None = "label",
    encoding: str = "UTF-8",
    columns=None,
    multi_line: bool = False,
):
    """Labelled (or, with ``label=None``, unlabelled) rows as strings.

    ``columns`` names the file's columns in order, which saves reading headers first;
    without it they are matched by header name. ``multi_line`` allows line breaks inside quotes,
    but then a file is one task, so large tables should come as many files.
    """
    reader = spark.read.options(**CSV, encoding=encoding, multiLine=multi_line)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    frame = reader.csv(path)
    picked = [F.col(text).cast("string").alias("text")]
    if label is not None:
        picked.append(F.col(label).cast("string").alias("label"))
    return frame.select(*picked)


def read_json(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """Labelled rows from JSON Lines."""
    return spark.read.schema(f"`{text}` string, `{label}` string").json(path).select(
        F.col(text).alias("text"), F.col(label).alias("label")
    )


def read_pool_json(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Unlabelled rows from JSON Lines whose lines are objects or bare strings."""
    lines = spark.read.text(path)
    return lines.select(
        F.coalesce(F.get_json_object("value", f"$.{text}"), F.get_json_object("value", "$")).alias("text")
    ).where(F.col("text").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per stripped line that is not blank."""
    return spark.read.text(path).select(strip_space(F.col("value")).alias("text")).where(F.col("text") != "")


def first_rows(rows: DataFrame, max_samples: int, order: str = "row_id") -> DataFrame:
    """The first ``max_samples`` rows in stored order."""
    return rows.orderBy(order).limit(max_samples)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_rows(rows: DataFrame, path: str, format: str = "csv") -> None:
    """Write as ``csv``, ``json`` or ``parquet``."""
    if format == "csv":
        write_csv(rows, path)
    elif format in ("json", "parquet"):
        getattr(rows.write, format)(path)
    else:
        raise ValueError(f"unsupported format {format!r}")


def export_training(seed: DataFrame, validated: DataFrame | None, path: str, format: str = "csv") -> None:
    """Write seed and validated rows as ``text, label``."""
    rows = seed.select("text", "label")
    if validated is not None:
        rows = rows.unionByName(validated.select("text", "label"))
    write_rows(rows, path, format)


def write_requests(requests: DataFrame, path: str) -> None:
    """One request per line, for batch inference."""
    requests.select("request").write.text(path)
