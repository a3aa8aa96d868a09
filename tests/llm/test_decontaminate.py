import random

import pytest
from helpers import awkward, clashing, documents, rows_of, words

from groundwork.llm import decontaminate as d


def plain(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add("" if name is None else str(name))
    out = []
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k:k + size]))
                if ids:
                    hit |= set(range(k, k + size))
                    found |= ids
        out.append((name, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ä", "c7"] if seed else [f"w{k}" for k in range(50)]
    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 4, 7, 10, 12, 30]))) for k in range(12)] + [(3, text(15)), (None, text(11)), (90, None), (91, ""), (92, " - ")]
    docs = [(k, text(rng.choice([0, 1, 5, 40, 200]))) for k in range(30)]
    docs += [(100 + k, text(20) + " " + (items[k][1] or "").upper() + " " + text(20)) for k in range(12)]
    docs += [(5, docs[5][1]), (5, "other"), (None, items[4][1]), (200, None)]
    got = rows_of(d.hits(documents(spark, docs), items_table(spark, items)), "doc_id", "n_words", "n_hit", "items")
    assert got == plain(docs, items)


def test_awkward_rows_and_names(spark):
    docs = awkward(spark)
    items = items_table(spark, [(1, " ".join(f"alpha{k} beta{k % 7} gamma" for k in range(4)))])
    rows = d.hits(clashing(docs), clashing(items)).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"] for r in rows if r["n_hit"]} == {5, 6, None}
    clean = d.clean(clashing(docs), items)
    assert clean.columns == clashing(docs).columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 1, 2, 3, 4, 7, 8]


def test_empty_tables(spark):
    none = items_table(spark, [])
    assert d.hits(documents(spark, []), none).count() == 0
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in d.hits(documents(spark, [(1, "a b")]), none).collect()] == [(2, 0, [])]


def test_a_window_of_very_many_items(spark):
    """A prompt line that hundreds of items share, in hundreds of documents: each document has all of them."""
    line = " ".join(f"prompt{k}" for k in range(12))
    items = spark.createDataFrame([(f"i{k:03d}", f"{line} own question {k} of many and so on") for k in range(300)], "item_id string, text string")
    docs = documents(spark, [(k, f"start {k} {line} end") for k in range(200)] + [(900, "clean words only")])
    got = {r["doc_id"]: (r["n_hit"], len(r["items"]), r["items"][:2]) for r in d.hits(docs, items).collect()}
    assert got.pop(900) == (0, 0, [])
    assert set(map(str, got.values())) == {str((12, 300, ["i000", "i001"]))}
