import random
import zlib

import numpy as np
import pytest
from helpers import awkward, clashing, documents

from groundwork.llm import toxicity as t
from groundwork.llm.words import Words


def texts(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "re", "ti", "on", "the", "ing", "el", "ür"]
    out = []
    for k in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 120))]
        if k % 2:
            w[rng.randrange(len(w))] = rng.choice(["grumf", "zonk" + rng.choice(syllables) + rng.choice(syllables)])
        out.append((" ".join(w).encode(), k % 2))
    return out


@pytest.fixture(scope="module")
def model():
    return t.train(*zip(*texts(400, 1)))


def score(model, rows):
    return t.scores(model, np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))


def test_held_out_texts_are_told_apart(model):
    rows = texts(300, 2)
    got = score(model, [r[0] for r in rows])
    assert ((got >= 0.5) == [r[1] for r in rows]).mean() > 0.97


def test_score_does_not_depend_on_neighbours_or_place(model):
    rows = [r[0] for r in texts(20, 3)]
    together = score(model, rows)
    assert np.allclose(together, [score(model, [r])[0] for r in rows], atol=1e-5)
    clean = b"batire onthe " * 300
    for at in (0, 7, 1500, 3900):  # a word is found anywhere in a long text
        assert score(model, [clean[:at].rsplit(b" ", 1)[0] + b" grumf " + clean[at:]])[0] > 0.5
    assert score(model, [clean])[0] < 0.5


def test_every_word_is_in_a_window():
    for n in (1, 5, t.WINDOW, t.WINDOW + 1, t.WINDOW + t.STEP, 1000):
        words = Words(np.frombuffer(b"ab " * n + b"cd", np.uint8), [0, 3 * n, 3 * n + 2])
        places, row = t.windows(words)
        assert set(places[row == 0].ravel()) - {-1} == set(range(n)) and set(places[row == 1].ravel()) - {-1} == {n}
        starts = places[row == 0][:, 0]
        assert (np.diff(starts) <= t.STEP).all()


def test_phrases_of_21_words_are_whole_in_a_window():
    for n in (21, 24, 25, 26, 27, 28, 29, 47, 48, 49, 500):
        words = Words(np.frombuffer(b"ab " * n, np.uint8), [0, 3 * n])
        held = {tuple(p[p >= 0]) for p in t.windows(words)[0]}
        assert all(any(set(range(at, at + 21)) <= set(w) for w in held) for at in range(n - 20))


def test_scores_do_not_depend_on_blocks(model, monkeypatch):
    rows = [r[0] for r in texts(40, 6)]
    want = score(model, rows)
    monkeypatch.setattr(t, "BLOCK", 7)
    assert np.allclose(score(model, rows), want, atol=1e-5)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in t.new_model(rng).items()}
    model["word"] *= 20
    model["gram"] *= 20
    words = Words(np.frombuffer(b"one two three four five six", np.uint8), [0, 27])
    vocabulary = t.Vocabulary(words)
    ids = np.array([[0, 1, 2, 3], [4, 5, 6, 6]])
    mask = np.array([[True] * 4, [True, True, False, False]])
    target = np.array([1, 0])

    def loss(m):
        x, _ = t.inputs_of(m, vocabulary)
        p = t.sigmoid(t.forward(m, x, ids, mask)[0])
        return -np.mean(np.where(target == 1, np.log(p), np.log(1 - p)))
    x, grams = t.inputs_of(model, vocabulary)
    grad, d_word, d_gram = t.gradients(model, vocabulary, x, grams, ids, mask, target)
    table = np.zeros_like(model["word"])
    np.add.at(table, vocabulary.word, d_word)
    grad["word"] = table
    table = np.zeros_like(model["gram"])
    np.add.at(table, vocabulary.gram, d_gram)
    grad["gram"] = table
    for name in ("wf", "ub", "cf", "attend", "out", "bias", "word", "gram"):
        flat = np.flatnonzero(grad[name].ravel())[:5]
        for at in flat:
            old, step = model[name].ravel()[at], 1e-2
            up, down = model[name].copy(), model[name].copy()
            up.ravel()[at], down.ravel()[at] = old + step, old - step
            want = (loss(model | {name: up}) - loss(model | {name: down})) / (2 * step)
            assert abs(grad[name].ravel()[at] - want) < 2e-3 + 0.05 * abs(want), name


def test_one_label_teaches_nothing():
    assert t.train([b"a b"], [1]) is None
    assert t.train([], []) is None


def test_awkward_rows(spark, model):
    docs = awkward(spark)
    rows = t.scored(clashing(docs), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert t.scored(documents(spark, []), model).count() == 0
    assert {r["score"] for r in t.scored(docs, None).collect()} == {0.0}


def test_training_rows_leave_out_held_out_rows(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(60)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    import zlib
    got, kinds = t.training_rows(docs, labels)
    want = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert got == [f"text {k}".encode() for k in want] and kinds == [k % 2 for k in want]


def test_texts_of_every_length_teach(spark):
    rng = random.Random(5)
    syllables = ["ba", "re", "ti", "on", "the", "ing", "el"]
    rows = []
    for k in range(80):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(4_000)]
        if k % 2:
            w[50::100] = ["grumf"] * 40
        rows.append((k, " ".join(w)))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    got, kinds = t.training_rows(documents(spark, rows), labels)
    texts = {k: text.split() for k, text in rows}
    taught = [k for k in range(80) if zlib.crc32(str(k).encode()) % 5]
    assert kinds == [k % 2 for k in taught]
    for k, windows in zip(taught, got):  # so many whole windows, from the first to the last part of the text
        assert len(windows) == len(set(windows)) == t.TRAIN_WINDOWS
        places = [min(at for at in range(len(texts[k])) if texts[k][at:at + t.WINDOW] == w.decode().split()) for w in windows[:20]]
        assert min(places) < 2_000 < max(places)
    assert got == t.training_rows(documents(spark, rows[::-1]), labels)[0]
    model = t.train(got, kinds)
    held = [(k, text) for k, text in rows if k not in taught]
    assert [int(s >= 0.5) for s in score(model, [text.encode() for _, text in held])] == [k % 2 for k, _ in held]


def test_windows_of_long_words_are_bounded():
    text = b" ".join(b"%03d" % k + b"x" * 997 for k in range(400))
    (windows,) = t.excerpts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert windows and sum(map(len, windows)) <= t.TRAIN_BYTES and all(w in text for w in windows)
    (windows,) = t.excerpts(np.frombuffer(text.replace(b" ", b""), np.uint8), np.array([0, len(text) - 399]))
    assert windows == [text.replace(b" ", b"")]  # never none


def test_labels_of_one_kind_without_documents_are_told(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="both kinds"):
        assert t.train(*t.training_rows(documents(spark, [(k, "text") for k in range(0, 60, 2)]), labels)) is None


def test_a_hot_id_does_not_crowd_the_sample(spark, monkeypatch):
    monkeypatch.setattr(t, "MAX_TOXIC", 20)
    monkeypatch.setattr(t, "MAX_CLEAN", 20)
    docs = documents(spark, [(1, f"copy {k % 3}") for k in range(200)] + [(k, f"text {k}") for k in range(2, 30)]).repartition(4)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1)] * 50 + [(k, 1, k % 2) for k in range(2, 30)], "doc_id long, quality int, toxic int")
    want = [k for k in range(1, 30) if zlib.crc32(str(k).encode()) % 5]
    assert want[0] == 1
    got, kinds = t.training_rows(docs, labels)
    assert got == [b"copy 0"] + [f"text {k}".encode() for k in want[1:]] and kinds == [0] + [k % 2 for k in want[1:]]
