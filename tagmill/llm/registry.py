"""Queries of this subpackage and the SQL that must give the same rows."""

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Register a function of ``(spark, sf_dir)`` under its name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
