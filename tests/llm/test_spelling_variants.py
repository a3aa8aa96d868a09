import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, clashing, documents, rows_of

from groundwork.llm import spelling_variants as v

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_counts(docs, noise=199):
    total = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def plain(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def vocabulary(seed, size):
    rng = random.Random(seed)
    letters = "abcdeéÿ"
    words = {"".join(rng.choice(letters[:3]) for _ in range(rng.randrange(4, 9))) for _ in range(size)}
    for word in list(words):
        k, c = rng.randrange(len(word)), rng.choice(letters)
        words |= {word[:k] + c + word[k:], word[:k] + word[k + 1:], word[:k] + c + word[k + 1:]}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "ab" * 40, "ab" * 40 + "a"}
    return {w: rng.choice([5, 6, 30, 150, 750, 4000]) for w in words if w}


@pytest.mark.parametrize("seed,block", [(0, 4096), (1, 16), (2, 5)])
def test_words_against_brute_force(spark, seed, block):
    words = vocabulary(seed, 150)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(v.variants(frame, block=block), *COLUMNS) == plain(words)


def test_narrow_tiles(spark, monkeypatch):
    monkeypatch.setattr(v, "TILE", 7)
    words = vocabulary(3, 60)
    group = np.zeros(len(words), int)
    names = sorted(w for w in words if len(w) in (6, 7))
    m, side = np.full(len(names), 6), np.zeros(len(names), int)
    found = {frozenset((names[a], names[b])) for x, y in v.near(names, group[:len(names)], m, side) for a, b in zip(x, y)}
    want = {frozenset((a, b)) for a in names for b in names if one_edit(a, b) and min(len(a), len(b)) == 6 and a[:3] == b[:3]}
    assert found == want and want


def corpus():
    rng = random.Random(4)
    stems = ["running", "Élan vital", "naïveté", "STRASSE", "colour", "color's", "behaviour", "behavior", "a×b÷cdefg", "über-cool", "façade", "facade", "wonderful"]
    return [(k if k % 17 else None, " ".join(rng.choice(stems) for _ in range(rng.randrange(60)))) for k in range(300)]


@pytest.mark.parametrize("noise", [199, 3])
def test_texts_against_brute_force(spark, noise):
    docs = corpus() + [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    words = v.word_counts(clashing(documents(spark, docs)).repartition(6), noise)
    want = plain_counts(docs, noise)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert rows_of(v.variants(words), *COLUMNS) == plain(want)


def test_hot_group_is_cut_into_blocks(spark):
    words = spark.range(3000).selectExpr("concat('samehalf', translate(lpad(id, 4, '0'), '0123456789', 'abcdefghij')) as word", "5L as n")
    cells = v.cells(v.halves(words), 256)
    assert cells.groupBy("cell", "bucket", "i", "j").count().agg({"count": "max"}).first()[0] <= 3 * 256


def test_empty_table(spark):
    assert v.variants(v.word_counts(documents(spark, []))).count() == 0
    assert v.variants(v.word_counts(documents(spark, [(1, None), (2, "")]))).count() == 0
