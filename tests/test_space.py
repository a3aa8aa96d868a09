"""What bounds memory and disk: no broadcast of units, no shuffle or staged table kept longer than it is read, work in slices of keys."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, differences
from groundwork import session
from groundwork.operators import grounding, ordering, segment

SF = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def staged(spark):
    session.ensure_checkpoint_dir(spark)
    return {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("stage-*")}


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(k)) for k in range(blocks.size()) if str(blocks.apply(k)).startswith("shuffle_")}


def test_units_of_a_small_looking_table_are_not_broadcast(spark):
    body = F.concat_ws("\n", F.lit("# T"), *[F.concat(F.lit("- Point "), "id", F.lit(f" of {n}.")) for n in range(20)])
    docs = session.stage(spark.range(300).select(F.lit("p").alias("pack_id"), F.concat(F.lit("S"), "id").alias("sid"), body.alias("body")))
    units = segment.units(segment.with_outline(docs), keep=("pack_id", "sid"))
    claims = docs.select("pack_id", F.col("sid").alias("claim_id"), F.array(F.concat("sid", F.lit(".u03")), F.lit("S0.u01"), F.lit("S9999.u01")).alias("cites"))
    cites = grounding.cited_passages(claims, units)
    assert "BroadcastHashJoin" not in plan(cites) and "SortMergeJoin" in plan(cites)
    assert {(r.claim_id, len(r.evidence)) for r in grounding.attached(claims, units).collect()} == {(f"S{k}", 2) for k in range(300)}


def test_shuffles_of_a_staged_table_go_with_its_write(spark):
    before = shuffle_files(spark)
    rows = session.stage(spark.range(1000).repartition(4, "id"))
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and rows.count() == 1000
    assert spark.conf.get(session._CLEANUP) == "false"


def test_tables_staged_on_the_way_are_deleted_and_no_others(spark):
    kept = session.stage(spark.range(5))
    before = staged(spark)
    inner = []

    def make():
        inner.append(session.settled(lambda: session.stage(spark.range(3))))
        return session.stage(inner[0].union(spark.range(2))).join(kept, "id")
    rows = session.settled(make)
    assert len(staged(spark) - before) == 1 and before <= staged(spark)
    assert sorted(r.id for r in rows.collect()) == [0, 0, 1, 1, 2] and kept.count() == 5


def test_slices_hold_every_row_once(spark):
    docs = session.stage(spark.range(1000).select((F.col("id") % 37).cast("string").alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1), (None, -2)], "k string, id long")))
    seen = []

    def work(part, other):
        seen.append(part.count())
        return ordering.number_rows(part, ["k"], ["id"], "n", partitions=3).join(other.withColumnRenamed("k", "o"), F.expr("k <=> o"), "left_semi")
    before = staged(spark)
    other = docs.select("k").distinct()
    cut = session.in_slices(work, "k", docs, other, most=2000)
    assert len(seen) > 2 and sum(seen) == 1002 and len(staged(spark) - before) == 1
    whole = session.in_slices(work, "k", docs, other)
    assert seen[-1] == 1002 and cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0


def test_places_go_on_over_batches_and_ranges(spark):
    """Keys that are NULL, NaN or equal for long stretches; batches of seven rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(400).select(
            F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("id") % 3).cast("double").alias("a"),
            F.when(F.col("id") % 2 == 0, "x").alias("b"), "id")
        got = ordering.number_rows(rows, ["a", "b"], ["id"], "n", partitions=9)
        rows.createOrReplaceTempView("placing")
        want = spark.sql("select a, b, id, cast(row_number() over (partition by a, b order by id) as bigint) n from placing")
        assert got.exceptAll(want).count() == 0 and got.count() == 400
        assert "SortMergeJoin" not in plan(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="tables not at hand")
@pytest.mark.parametrize("name", ["evidence_attached", "verdict_resolution", "conflict_notices", "claim_error_rows", "cross_tier", "unjudged_claims", "evidence_payload", "report_assembly"])
def test_query_in_slices_agrees_with_sql(spark, monkeypatch, name):
    monkeypatch.setattr(session, "SLICE_BYTES", 70_000)
    made = []
    monkeypatch.setattr(session, "settled", lambda make, path=None, f=session.settled: made.append(path) or f(make, path))
    assert differences(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) == []
    assert len([p for p in made if p]) > 1
