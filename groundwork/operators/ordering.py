"""Numbering and latest-row choices that survive a hot key."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork import session


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions)


def _starts(column):
    """Whether each value but the first differs from the one before, as grouping tells values apart."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    if pa.types.is_floating(column.type):
        same = pc.or_(pc.equal(a, b), pc.and_(pc.is_nan(a), pc.is_nan(b)))
    else:
        same = pc.equal(a, b)
    same = pc.or_kleene(same, pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)


def _places(keys):
    """A task's rows, which are in order, with the place of each among the rows of its key in this task, from 1.

    ``_edge`` marks the task's first row (1), its last (2), or both in one (3).
    """
    def placed(batches):
        last, count, held = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            before = last or [c.slice(0, 1) for c in columns]
            new = np.logical_or.reduce([_starts(pa.concat_arrays([b, c])) for b, c in zip(before, columns)])
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + count + 1, at - start + 1)
            edge = np.zeros(n, np.int32)
            edge[0] = last is None
            last, count = [c.slice(n - 1, 1) for c in columns], int(place[-1])
            if held:
                yield ended(*held)
            held = batch, place, edge
        if held:
            held[2][-1] += 2
            yield ended(*held)

    def ended(batch, place, edge):
        task = np.full(len(edge), TaskContext.get().partitionId())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(edge, pa.int32()), pa.array(task, pa.int32())],
                                          [*batch.schema.names, "_place", "_edge", "_stretch"])
    return placed


def number_rows(rows, keys, order, name, partitions=None):
    """Number the rows of each key 1, 2, 3, ... in ``order``.

    A window over the key would sort a hot key in one task. Here whole rows are dealt in
    ranges of the order columns, so a hot key spreads over many tasks, and written in
    that order once, each with its place among the rows of its key in its range. That is one shuffle of the rows.
    Only the key a range begins with can have rows in earlier ranges: how many is a table of a row per range at most, which
    is broadcast with its keys. Rows equal in keys and order have places of their own, so none is multiplied.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    dealt = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, k) for c, k in (("_place", T.LongType()), ("_edge", T.IntegerType()), ("_stretch", T.IntegerType()))]])
    ranged = session.stage(dealt.mapInArrow(_places(keys), schema))
    # The first and last rows of the ranges: a key that goes on from range to range is the last of all but one.
    ends = ranged.filter("_edge > 0").select("_stretch", "_edge", "_place", F.struct(*[F.col(k) for k in keys]).alias("_key"))
    last = F.when(F.col("_edge") >= 2, F.col("_place")).otherwise(0)
    earlier = Window.partitionBy("_key").orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("_base", F.sum(last).over(earlier)).filter("_edge <> 2 and _base > 0").select(F.col("_stretch").alias("_o_stretch"), "_key", "_base")
    begins = _all([F.col(k).eqNullSafe(F.col("_key")[k]) for k in keys])
    rows_before = F.coalesce(F.when(begins, F.col("_base")), F.lit(0))
    numbered = ranged.join(F.broadcast(offsets), F.col("_stretch") == F.col("_o_stretch"), "left")
    return numbered.select(*rows.columns, (F.col("_place") + rows_before).cast("bigint").alias(name))


def latest(rows, keys, order):
    """All rows of each key that carry its highest ``order`` value (a rank of one, descending).

    The highest value comes from an aggregate with a map-side step and is joined
    back, so no task has to hold a key's rows.
    """
    top = rows.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.max(order).alias("_top"))
    match = _all([F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys] + [F.col(order) == F.col("_top")])
    return rows.join(top, match).select(*rows.columns)


def last_by(rows, keys, order):
    """One row per key: the one with the highest ``order``, kept by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
