import hashlib
import random
import re

import pytest
from helpers import awkward, clashing, documents

from groundwork.llm import mixing as m


def share_out(budget, rooms, weights):
    """Water filling by rounds: what a full child cannot take goes to the others by weight."""
    given, open_ = {k: 0.0 for k in rooms}, {k for k in rooms if weights[k] > 0}
    while open_:
        rest = budget - sum(given[k] for k in rooms if k not in open_)
        level = rest / sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] <= level * weights[k] + 1e-12}
        for k in full:
            given[k] = rooms[k]
        open_ -= full
        if not full:
            for k in open_:
                given[k] = level * weights[k]
            break
    return given


def weight(path, weights):
    return weights.get("/".join(path), weights.get("*/" + path[-1], 1.0))


def plain_budgets(leaves, weights, share, epochs):
    def room(path):
        if len(path) == 3:
            return leaves[path] * epochs
        return sum(room(c) for c in children(path) if weight(c, weights) > 0)
    def children(path):
        return sorted({leaf[:len(path) + 1] for leaf in leaves if leaf[:len(path)] == path})
    out = {}
    def down(path, budget):
        if len(path) == 3:
            out[path] = int(budget + 1e-6)
            return
        given = share_out(budget, {c: room(c) for c in children(path)}, {c: weight(c, weights) for c in children(path)})
        for c, b in given.items():
            down(c, b)
    down((), float(int(sum(leaves.values()) * share)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_and_prefixes(spark, seed):
    rng = random.Random(seed)
    sources = ["src0", "src1", "src6", "x", None]
    docs = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 50])), rng.choice(["en", "de", None]), rng.choice(sources), 0) for k in range(200)]
    weights = {"crawl": rng.choice([0.0, 1.0, 9.0]), "reference": 3.0, "*/en": 5.0, "*/de": rng.choice([0.0, 1.0]), "other/en/x": 0.5}
    share, epochs = rng.choice([(0.3, 1), (0.8, 2), (2.5, 2), (1.0, 3)])
    rows = m.mix(documents(spark, docs), weights=weights, share=share, max_epochs=epochs, seed=4).collect()
    domain = {s: d for d, names in m.DOMAINS.items() for s in names}
    leaf_of = {d[0]: (domain.get(d[3], "other"), d[2] or "", d[3] or "") for d in docs}
    tokens = {d[0]: len(re.findall(r"\S+", d[1])) for d in docs}
    leaves = {}
    for k, leaf in leaf_of.items():
        leaves[leaf] = leaves.get(leaf, 0) + tokens[k]
    want = []
    for leaf, budget in plain_budgets(leaves, weights, share, epochs).items():
        inside, epoch = [k for k in leaf_of if leaf_of[k] == leaf], 0
        while leaves[leaf] and budget >= leaves[leaf]:
            want += [(k, epoch) for k in inside]
            budget, epoch = budget - leaves[leaf], epoch + 1
        inside.sort(key=lambda k: (hashlib.md5(f"4:{epoch}:{k}".encode()).hexdigest(), k))
        for k in inside:
            if not budget or tokens[k] > budget:
                break
            budget -= tokens[k]
            want.append((k, epoch))
            if not budget:  # texts without tokens that follow still fit
                budget = 0.5
    assert sorted((r["doc_id"], r["epoch"]) for r in rows) == sorted(want)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s", 10), ("a", "en", "t", 1000), ("b", "en", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["source"]): r["budget"] for r in m.budgets(leaves, {}, 0.5, 1).collect()}
    assert got == {("a", "s"): 10, ("a", "t"): 492, ("b", "s"): 502}


def test_awkward_rows_and_empty_table(spark):
    docs = clashing(awkward(spark))
    rows = m.mix(docs, share=1.0, max_epochs=1).collect()
    assert len(rows) == docs.count()  # every row fits
    assert m.mix(documents(spark, [])).count() == 0
    assert m.mix(documents(spark, [(1, None), (2, "")])).count() == 0
