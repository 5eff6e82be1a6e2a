"""Access to the given tables and registration of queries."""

from __future__ import annotations


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(found: dict, sql: str | None = None, name: str | None = None):
    """Decorator: add a query under its function's name, with its SQL equivalent."""

    def add(f):
        found[name or f.__name__] = (f, sql)
        return f

    return add
