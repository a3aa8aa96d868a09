from pathlib import Path

import pytest
from helpers import awkward, clashing, documents

import __spark_entry__ as entry
import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="tables not at hand")


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, name, stage):
    docs = clashing(awkward(spark))
    out = stage(spark, docs, SF)
    out.collect()
    if stage is not p.STAGES[-1][1]:
        assert out.columns == docs.columns
    assert stage(spark, documents(spark, []), SF).count() == 0


def test_run_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.shared.stage(stage(spark, docs, SF))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    last = {(r["doc_id"], r["epoch"]) for r in p.STAGES[-1][1](spark, docs, SF).collect()}
    assert {(r["doc_id"], r["epoch"]) for r in entry.queries()["pipeline"](spark, SF).collect()} == last
    kept = {r["doc_id"] for r in docs.collect()}
    assert {d for d, _ in last} <= kept


def test_each_dealt_operator_has_a_query():
    names = entry.queries()
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
