import random
import re
import time

from helpers import awkward, clashing, documents, words

from groundwork.llm import license_scan as x


def plain_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in x.PHRASES.items():
        p = phrase.encode().split()
        for k in range(len(w)):
            if w[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "MIT License", "mit-license mit  license! MIT\nLICENSE apache license", "submit license", "mit licenses", "the Apache License, Version 2.0",
         "gnu GENERAL public license, general public license", "mit éa license", "a mit license apache license mit license", "permitlicense mit0 license",
         "mit " * 5 + "license", "general public  mit license"]


def test_base_places_agree_with_the_definition(spark):
    got = {r["doc_id"]: r for r in x.scanned(documents(spark, list(enumerate(TEXTS)))).collect()}
    for k, text in enumerate(TEXTS):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def scan(text):
    return x.scan(text.encode(), tuple(x.PHRASES.items()), x.NOTICES)


def test_errors_within_the_bound_are_found_with_their_span():
    _, base, spans = scan("Foo. Relased undr the MIT Licence. Bar")
    assert base == [] and [(s[0], s[1], s[2]) for s in spans] == [("mit", 1, 5)] and spans[0][3] == 3
    assert scan("Foo. Relsed undr th MIT Licence. Bar")[2] == []
    assert scan("released under the omit license")[2] != []
    assert scan("nothing to see here")[2] == []


def test_neighbouring_notices_are_all_found():
    _, _, spans = scan("released under the mit license " * 3)
    assert [s[:3] for s in spans] == [("mit", 0, 4), ("mit", 5, 9), ("mit", 10, 14)]


def near_places(notice, errors, line):
    """Whether a run of whole words of the line is within so many edits of the notice: all starts and ends, by dynamic programming."""
    row = [0 if k and line[k - 1] == " " else errors + 1 for k in range(len(line) + 1)]  # a match starts behind a space
    for i, c in enumerate(notice, 1):
        after = [row[0] + 1]
        for k, d in enumerate(line, 1):
            after.append(min(row[k - 1] + (c != d), row[k] + 1, after[k - 1] + 1))
        row = after
    return any(row[k] <= errors and line[k] == " " for k in range(len(line)))


def test_labels_and_score_against_all_edit_distances(spark):
    rng = random.Random(3)
    texts = []
    for k in range(150):
        label, notice, errors = rng.choice(x.NOTICES)
        letters = list(notice)
        for _ in range(rng.randrange(errors + 3)):
            at = rng.randrange(len(letters))
            letters[at:at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "e", " ", letters[at] + "z"])
        texts.append(" ".join(rng.choice(["foo", "the", "license", "mit", "of", "Bar,"]) for _ in range(rng.randrange(6))) + " " + "".join(letters) + rng.choice([" and", ". Next", ""]))
    got = {r["doc_id"]: r for r in x.scanned(documents(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        line = " " + " ".join(w.decode() for w in words(text)) + " "
        want = {label for label, notice, errors in x.NOTICES if near_places(notice, errors, line)} | set(filter(None, plain_base(text)[4].split(",")))
        assert got[k]["labels"] == ",".join(sorted(want)), text
        assert (got[k]["score"] > 0) == bool(want)
        for span in got[k]["spans"]:
            found = words(text)[span["first_word"]:span["last_word"] + 1]
            assert any(near_places(n, e, " " + b" ".join(found).decode() + " ") for lab, n, e in x.NOTICES if lab == span["label"])


def test_time_is_in_proportion_to_a_text_of_hits():
    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        _, base, _ = scan("mit license " * n)
        took.append(time.process_time() - start)
        assert len(base) == n and base[-1][1] == 2 * n - 2
    assert took[1] < 8 * 3 * took[0]


def test_pieces_cover_the_notice():
    for _, text, errors in x.NOTICES:
        parts = x.pieces(text, errors)
        assert len(parts) == errors + 1 and "".join(p for _, p in parts) == text and all(text[a:].startswith(p) for a, p in parts)


def test_notices_are_words_with_single_spaces():
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", text) for _, text, _ in x.NOTICES)


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    assert x.scanned(clashing(docs)).count() == docs.count()
    assert x.scanned(documents(spark, [])).count() == 0
