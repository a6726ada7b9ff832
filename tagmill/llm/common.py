"""Helpers that several operators share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ASCII white space, as the word definitions of the operators have it.
WORD = r"[^\x20\x09-\x0D]+"


def packed(docs: DataFrame) -> DataFrame:
    """Every input column in one struct ``doc``, so that no working column can clash."""
    return docs.select(F.struct("*").alias("doc"))


def unpacked(rows: DataFrame, added: list[str]) -> DataFrame:
    """Input columns again, followed by ``added``; an input column of such a name is replaced."""
    fields = [name for name in rows.schema["doc"].dataType.fieldNames() if name not in added]
    return rows.select(*[F.col("doc").getField(name).alias(name) for name in fields], *added)


def group_key(*columns):
    """One string per combination of values; null is a value of its own."""
    return F.to_json(F.struct(*[c.cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))
