import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, clashing, documents, rows_of

from groundwork.llm import line_dedup as d

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def plain(docs, least, shortest=1, keep_first=False):
    lines = [(name, (text or "").split("\n")) for name, text in docs]
    times = Counter(k for _, ls in lines for k in {key(line) for line in ls})
    bad = {k for k, n in times.items() if n >= least and len(k) >= shortest}
    first = {}
    for name, ls in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0)):
        for k in bad & {key(line) for line in ls}:
            first.setdefault(k, name)
    out = []
    for name, ls in lines:
        kept, held = [], set()
        for line in ls:
            k = key(line)
            if k not in bad or keep_first and first[k] == name and k not in held:
                kept.append(line)
                held.add(k)
        out.append((name, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    shared = ["Cookie notice", " cookie NOTICE\t", "", "  ", "é", "É", "x" * 5000, "Menu", "\x0bmenu\x0c", "all rights reserved", "a\rb"]
    docs = [(k, "\n".join(rng.choice(shared + [f"own line {k} {n}" for n in range(6)]) for _ in range(rng.randrange(1, 12)))) for k in range(80)]
    return docs + [(900, None), (901, ""), (902, "\n"), (None, "Menu\nMenu\nmenu "), (903, "Menu\nlast\nMENU"), (903, "Menu\nlast\nMENU")]


@pytest.mark.parametrize("most", [d.BROADCAST_LINES, 0])
@pytest.mark.parametrize("least,shortest", [(10, 1), (2, 0), (3, 5)])
def test_against_brute_force(spark, least, shortest, most):
    docs = corpus(least)
    got = rows_of(d.line_counts(documents(spark, docs).repartition(7), least, shortest, bits=1 << 12, most=most), *COLUMNS)
    assert got == plain(docs, least, shortest)


@pytest.mark.parametrize("most", [d.BROADCAST_LINES, 0])
def test_first_line_stays(spark, most):
    docs = [x for x in corpus(5) if x[0] != 903]
    got = rows_of(d.line_counts(documents(spark, docs).repartition(5), 2, keep_first=True, most=most), *COLUMNS)
    assert got == plain(docs, 2, keep_first=True)


def test_filter_holds_every_key_of_two_documents(spark):
    docs = [(k, f"own {k}\nshared {k // 2}\nalso own {k}") for k in range(400)]
    filled = d.Seen(8)
    filled.twice = d.seen_again(documents(spark, docs).repartition(9), bits=1 << 16)
    again = d.digests([f"shared {k}".encode() for k in range(200)])
    assert filled.holds(again).all()
    once = d.digests([f"own {k}".encode() for k in range(400)])
    assert filled.holds(once).mean() < 0.05


def test_merging_counts_a_place_of_two_tasks_twice():
    one, two, both = d.Seen(1 << 10), d.Seen(1 << 10), d.digests([b"a", b"b", b"c"])
    one.add(both[:2])
    two.add(both[1:])
    assert not one.twice.any()
    one.merge(two.once, two.twice)
    assert one.holds(both).tolist()[1] and _bits(one.once) >= 3
    packed = d._packed(one.once)
    assert (d._unpacked(packed, 1 << 10) == one.once).all()


def _bits(data):
    return int(np.unpackbits(data).sum())


def test_hot_line_and_awkward_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()] + [(1000 + k, "hot line\n" + ("y" * 30 if k % 3 else f"own {k}")) for k in range(3000)]
    got = rows_of(d.line_counts(clashing(documents(spark, docs)).repartition(11)), *COLUMNS)
    assert got == plain(docs, 10)


def test_columns_and_nulls_stay(spark):
    docs = clashing(documents(spark, [(k, "Same\nown " + str(k)) for k in range(12)] + [(50, None), (51, "same")]))
    out = d.drop_lines(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[3] == "own 3" and texts[50] is None and texts[51] == ""


def test_empty_table(spark):
    assert d.line_counts(documents(spark, [])).count() == 0
    assert d.drop_lines(documents(spark, []), most=0).count() == 0
