"""Parquet tables as inputs."""


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows):
    """Even out a table that arrives in fewer partitions than there are cores.

    Text work is heavy per row, so a single-file table would keep one core busy. A
    large table has partitions enough and is left as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
