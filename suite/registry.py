"""Collects queries and the SQL that must give the same rows."""

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``(spark, sf_dir)`` under its name."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add
