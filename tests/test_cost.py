"""What keeps the cost of reading a text down: no interpreted array functions, no NULL lists in Arrow batches, cheap gates."""

import re

import pytest
from pyspark.sql import functions as F

from groundwork import fixed
from groundwork.functions import numbers
from groundwork.operators import segment


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_cutting_a_document_interprets_no_array_function(spark):
    docs = spark.createDataFrame([("p", "S1", "# T\n\nOne. Two.")], "pack_id string, sid string, body string")
    units = segment.units(segment.with_outline(docs), keep=("pack_id", "sid"), windows=True)
    assert "lambda" not in plan(units) and "lambda" not in plan(segment.table_cells(units.select("uid", "quote")))


@pytest.mark.parametrize("quote, cells", [
    ("Cap\n| a | **b** |\n|---|:-:|\n| 1 ||", None), ("| a | b |\n|---|---|\n| 1 |  |", [["a", "b"], ["1", ""]]),
    ("**Cap**\n|a|b|\n|:---|---:|\n|1|2|\n|3|4|", [["a", "b"], ["1", "2"], ["3", "4"]]), ("| a |\n|---|\n| 1 |", None),
    ("| a | b |\n|---|---|\n|---|---|", None), ("| a | b |\n|---|---|\n| 1 | 2", None), ("x\ny\n| a | b |\n|---|---|\n| 1 | 2 |", None)])
def test_tables_are_read_whole_or_not_at_all(spark, quote, cells):
    rows = segment.table_cells(spark.createDataFrame([(quote,)], "quote string")).collect()
    got = {(r.row, r.col): r.cell for r in rows}
    assert got == {(i, j): c for i, row in enumerate(cells or []) for j, c in enumerate(row)}


def test_no_null_list_goes_to_python(spark):
    """Each NULL list of an Arrow batch makes Spark fill all offsets before it again for every later row."""
    rows = spark.createDataFrame([("Rs 5 crore.", "Rs 6 crore.")], "t string, e string")
    found = rows.select(numbers.number_errors(F.col("t"), F.col("e"), F.lit("")).alias("errors"))
    assert not re.search(r"_errors\([^\n]*\bnull\b", plan(found))
    assert found.first().errors == ["Number 5 (rupees) is not supported by the cited quotes"]


def test_leading_tests_turn_no_match_away(spark):
    """Letters that fold to ASCII ones only in Unicode still begin a match."""
    texts = ["ſeptember 4, 2026", "4 ſept 2026", "ıncreased 5%", "İncrease of 5", "10 　to 20 percent", "5 6 bps", "7 -\t8", "FY 26", "q1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (fixed.FULL_DATE, fixed.PERIOD, fixed.RANGE_UNIT, fixed.RANGE_HYPHEN, numbers._QUANTITY):
        # The leading lookahead is dropped up to the flags; the rest alone is the rule.
        bare = re.sub(r"\A(?:\(\?[=!](?:\[(?:[^\]\\]|\\.)*\]|[^()])*\))+", "", pattern)
        assert bare != pattern
        assert rows.filter(~(F.regexp_replace("t", pattern, "#").eqNullSafe(F.regexp_replace("t", bare, "#")))).collect() == []


def test_the_gate_of_leads_passes_every_lead(spark):
    ends = ["₹", "~", "5", "5,", "Rs", "rs.", "Q", "FY", "by", "approx.", "fell", "fall  of", "September.", "sept.", "May  ", "١", "grew by\t"]
    texts = [f"It was {e}" for e in ends] + ["Done.", "It fell 5.", "| a |"]
    rows = spark.createDataFrame([(t,) for t in texts], "quote string").select("quote", F.lit("t").alias("title"), F.lit(None).cast("date").alias("d"))
    got = rows.select("quote", numbers.read_passage(F.col("quote"), F.col("title"), F.col("d"))["joint"].contains("l").alias("lead"),
                      F.col("quote").rlike(numbers._LEADS).alias("want")).collect()
    assert [r.quote for r in got if r.lead != r.want] == [] and sum(r.want for r in got) >= len(ends)


def test_counting_hidden_content_interprets_no_array_function(spark):
    from groundwork.functions.text import hidden_counts
    rows = spark.createDataFrame([("a<!-- b -->​c",), ("plain",), (None,)], "t string").select(hidden_counts(F.col("t")).alias("r"))
    assert "lambda" not in plan(rows)
    assert [r.r and [tuple(x) for x in r.r] for r in rows.collect()] == [[("html_comment", 10), ("unicode_format", 1)], [], None]
