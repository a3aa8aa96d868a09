"""Small helper shared by the query modules."""

from pyspark.sql import functions as F


def registry():
    """(queries, oracles, decorator) of one module."""
    queries, oracles = {}, {}

    def query(name, sql=None):
        def add(fn):
            queries[name] = fn
            if sql:
                oracles[name] = sql
            return fn
        return add

    return queries, oracles, query


def joined(items, by=" | "):
    return F.array_join(items, by)
