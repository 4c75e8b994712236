"""The queries by name, and SQL for the same results."""

from __future__ import annotations

import functools

from granary.sources.shared import ship_package

QUERIES, SQL = {}, {}


def shipped(f):
    """The query, after this package was sent to the Python workers."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
