import re

import numpy as np
import pytest
from helpers import awkward, clashing, documents

from groundwork.llm import quality_rules as q


def plain_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[k:k + 3]) for k in range(len(found) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


TEXTS = ["", "a", "a b c a b c a", "x x x x", "über #1\nüber #1\n\n  \n \n", "one two three\tone two three\r\none two", "a b a b <b> 100%",
         "a b c d a b c e a b c", "l1\nl1\nl2\nl1 \n"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_agree_with_the_definition(text):
    assert q.counts(text.encode())[:5] == plain_counts(text)


def test_awkward_rows_each_give_a_row(spark):
    docs = awkward(spark)
    rows = q.judge(clashing(docs), [(("symbol_share", ">", 0.5),)]).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["n_words"] == 0 and by[k]["base_failed"] and not by[k]["kept"] for k in (1, 2, 3))
    assert by[4]["n_words"] == 40_000
    assert by[5]["kept"] and by[6]["kept"]


def test_rules_are_learned_grown_and_pruned():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (900, len(q.FEATURES)))
    bad = ((x[:, 1] > 0.7) & (x[:, 2] > 0.5)) | (x[:, 3] > 0.9)
    rules = q.learn(x, bad)
    names = list(q.FEATURES)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= q.covers([(names.index(f), sign, cut) for f, sign, cut in rule], x)
    assert (hit == bad).mean() > 0.97
    assert (hit & ~bad).sum() <= 0.03 * hit.sum()
    assert q.learn(x[::-1], bad[::-1]) == rules  # the order of the rows does not matter


def test_no_labels_no_rules(spark):
    docs = documents(spark, [(1, "some text")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    x, bad = q.training_rows(docs, labels)
    assert q.learn(x, bad) == []
    labels = spark.createDataFrame([(1, None, 0), (None, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.learn(*q.training_rows(docs, labels)) == []
    assert [r["kept"] for r in q.judge(docs, []).collect()] == [False]


def test_ordered_expression_names_the_first_rule(spark):
    docs = documents(spark, [(1, "### word " * 60), (2, "plain words here " + " ".join(f"w{k}" for k in range(60)))])
    rules = [(("symbol_share", ">", 0.9),), (("symbol_share", ">", 0.1), ("mean_word", "<=", 50.0)), (("symbol_share", ">", 0.05),)]
    assert {r["doc_id"]: r["rule"] for r in q.judge(docs, rules).collect()} == {1: 2, 2: 0}


def test_empty_table(spark):
    assert q.judge(documents(spark, []), []).count() == 0


def test_kept_keeps_all_columns(spark):
    docs = clashing(awkward(spark))
    kept = q.kept(docs, [])
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 5, 6]


def test_a_hot_id_does_not_crowd_the_sample(spark):
    docs = documents(spark, [(1, "one two")] * 200 + [(k, "word " * k) for k in range(2, 22)]).repartition(4)
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0)] * 50 + [(k, k % 2, 0) for k in range(2, 22)], "doc_id long, quality int, toxic int")
    x, bad = q.training_rows(docs, labels, max_rows=30)
    assert len(x) == len(bad) == 21 and bad.sum() == 11
