import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, clashing, documents, rows_of

from groundwork.llm import suffix_dedup as s


def plain(docs, span):
    texts = [(name, (text or "").encode()) for name, text in docs]
    times = Counter(t[k:k + span] for _, t in texts for k in range(len(t) - span + 1))
    out = []
    for name, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - span + 1):
            if times[t[k:k + span]] > 1:
                gone[k + 1:k + 1 + span] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((name, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    letters = {0: "abcdefghijklmnopqrstuvwxyz ", 1: "ab", 2: "aäß", 3: "abcdefgh"}[seed]
    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (size - 1, size, size + 1, 2 * size, 5 * size)]
    docs = [(k, text(rng.choice([0, 3, size, 4 * size]))) for k in range(12)]
    for k in range(30):  # passages with other surroundings, cut at either end
        passage = rng.choice(shared)
        a, b = sorted(rng.sample(range(len(passage) + 1), 2))
        docs.append((50 + k, text(rng.randrange(2 * size)) + rng.choice([passage, passage[a:], passage[:b]]) + text(rng.randrange(2 * size))))
    whole = text(6 * size)
    for k in range(10):  # near copies
        at = rng.randrange(len(whole))
        docs.append((90 + k, whole[:at] + rng.choice(letters) + whole[at + 1:]))
    docs += [(120, "x" * 4 * size), (121, "abc" * 3 * size), (122, whole), (122, whole), (123, shared[4] * 2), (124, None), (None, shared[3])]
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    docs = corpus(seed, 24)
    got = rows_of(s.digests(documents(spark, docs), 24, 5), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain(docs, 24)


@pytest.mark.parametrize("seed,size", [(3, 300), (1, 60), (0, 1), (2, 900)])
def test_grams_too_large_for_a_task(spark, monkeypatch, seed, size):
    monkeypatch.setattr(s, "RANGE_BYTES", size)  # many ranges, so many rows at their ends
    docs = corpus(seed, 24)
    got = rows_of(s.digests(documents(spark, docs), 24, 5), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain(docs, 24)


def test_many_near_copies_of_one_text(spark, monkeypatch):
    """A hot gram: each copy has edits of its own, so its segments differ and match in part."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef ") for _ in range(260))
    docs = []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randrange(1, 4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        docs.append((k, "".join(text)))
    want = plain(docs, 60)
    for size in (s.RANGE_BYTES, 4000):
        monkeypatch.setattr(s, "RANGE_BYTES", size)
        assert rows_of(s.digests(documents(spark, docs), 60, 8), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("seed,size", [(0, None), (1, None), (2, None), (3, None), (3, 300), (1, 60)])
def test_two_lengths_at_once_against_brute_force(spark, monkeypatch, seed, size):
    """Passages shorter than the strings that go are counted beside them, and what goes stays as it is."""
    if size:
        monkeypatch.setattr(s, "RANGE_BYTES", size)
    docs = corpus(seed, 24)
    got = s.digests(documents(spark, docs), 24, 5, passage=15).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(docs, 24)
    assert sorted(((r["doc_id"], r["n_passage_bytes"]) for r in got), key=repr) == sorted(((r[0], r[2]) for r in plain(docs, 15)), key=repr)


def test_query_reports_passages_of_fifty_words(spark, tmp_path):
    """51 words in 250 to 399 bytes stay in the text, as strings of 400 bytes are asked for, but do not go unseen."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(4000)]
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    passage = text(51)
    assert 250 <= len(passage) < s.SPAN
    docs = [(k, f"{text(90)}. {passage}! {text(90)}") for k in range(4)] + [(10 + k, text(230)) for k in range(4)]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in s.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[d]["n_removed"] for d, _ in docs] == [0] * 8
    assert [got[d]["n_passage_bytes"] >= len(passage) for d, _ in docs] == [True] * 4 + [False] * 4
    assert [got[d]["n_passage_bytes"] for d, _ in docs[4:]] == [0] * 4


def test_sample_has_a_place_for_every_window():
    data = np.frombuffer(b"abracadabra" * 40 + bytes(range(256)) + b"z" * 90, np.uint8)
    parts = list(s.sample(data, 40, 8))
    assert [w for _, _, first, last in parts for w in range(first, last + 1)] == list(range(len(data) - 39))
    assert all(last <= place <= first + 32 for _, place, first, last in parts)


def test_awkward_rows_at_full_span(spark):
    docs = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    docs = [d for d in docs if d[0] != 4] + [(4, " ".join(f"w{k}" for k in range(3000)))]
    got = rows_of(s.digests(clashing(documents(spark, docs))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain(docs, 400)


def test_cut_keeps_columns_and_code_points(spark):
    docs = clashing(documents(spark, [(1, "é" * 30 + "tail"), (2, "q" + "é" * 30), (3, None), (4, "")]))
    cut = s.cut(docs, 24, 5)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "tail", 2: "q", 3: None, 4: ""}


def test_empty_table(spark):
    assert s.digests(documents(spark, [])).count() == 0
