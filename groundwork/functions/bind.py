"""Evaluate a column once and use it many times inside one expression."""

from pyspark.sql import functions as F


def let(column, use):
    """``use(column)`` with the column computed a single time per row.

    Array functions are not shared by Spark's common-subexpression step, and a
    column named inside a lambda is computed again for every element. Binding it
    as the lambda's variable avoids both.
    """
    return F.get(F.transform(F.array(column), use), 0)


def empty(ddl):
    return F.expr(f"cast(array() as array<{ddl}>)")
