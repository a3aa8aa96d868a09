import itertools
import random

import pytest
from helpers import awkward, clashing, documents, rows_of, words

from groundwork.llm import jaccard_join as j


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(docs):
    return sorted(in_order(docs), key=repr)


def in_order(docs):
    """(doc_id, class_id, n_links) for each row."""
    sets = [shingles(t) for _, t in docs]
    links = [[] for _ in docs]
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a].append(b)
            links[b].append(a)
    out, group = [], {}
    for k in range(len(docs)):
        if k not in group:
            stack, seen = [k], {k}
            while stack:
                for m in links[stack.pop()]:
                    if m not in seen:
                        seen.add(m)
                        stack.append(m)
            group |= dict.fromkeys(seen, seen)
        ids = [docs[m][0] for m in group[k] if docs[m][0] is not None]
        out.append((docs[k][0], min(ids) if ids else None, len(links[k])))
    return out


def corpus(seed, groups=12, most=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                at = rng.randrange(len(text) + 1)
                text[at:at + rng.randint(0, 2)] = rng.sample(vocabulary, rng.randint(0, 2))
            docs.append((n, rng.choice([" ", ", "]).join(text)))
            n += 1
    return docs + [(500, None), (501, ""), (502, "w1"), (503, "W1!"), (2, docs[2][1]), (None, docs[5][1]), (None, None), (3, "w9 w8")]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert rows_of(j.grouped(documents(spark, docs)), "doc_id", "class_id", "n_links") == plain(docs)


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_CLASSES", 4)
    docs = corpus(7, groups=4, most=40)
    assert rows_of(j.grouped(documents(spark, docs)), "doc_id", "class_id", "n_links") == plain(docs)


def test_stop_depth_reaches_the_target():
    depth = j.stop_depth()
    assert 1 - (1 - 0.8 ** depth) ** j.TREES >= j.TARGET_RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** j.TREES


def test_first_of_groups(spark):
    docs = corpus(3)
    frame = clashing(documents(spark, docs))
    kept = j.first_of_groups(frame)
    assert kept.columns == frame.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    want = [name for name, text in docs if not words(text)]
    want += {group for (_, group, _), (_, text) in zip(in_order(docs), docs) if words(text)}
    assert got == sorted(want, key=repr)


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    rows = j.grouped(clashing(docs)).collect()
    assert len(rows) == docs.count()
    assert sorted(r["n_links"] for r in rows) == [0] * 7 + [3] * 4
    assert j.grouped(documents(spark, [])).count() == 0
    assert j.first_of_groups(documents(spark, [])).count() == 0
