"""What the operators share: reading tables, projections with fixed names, staged tables."""

from pyspark.sql import functions as F

from groundwork import session


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs):
    """Only the id and the text; whatever else the input carries cannot clash with names used inside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def stage(rows):
    """A table written once in the shared checkpoint folder; lost executors cost only their running tasks.

    The grouped side of a join with a hot key is staged too: Spark splits a skewed partition only
    where both sides come straight from a shuffle.
    """
    return session.stage(rows)


def with_columns(rows, columns):
    """Columns added in one projection; a column of the input with such a name is replaced."""
    names = {name.lower() for name in columns}
    return rows.select(*[F.col(f"`{name}`") for name in rows.columns if name.lower() not in names],
                       *[column.alias(name) for name, column in columns.items()])
