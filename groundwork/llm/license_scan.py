"""License scans: exact phrases, and short notices with a few errors.

Notices are compared on lower-cased words with one space between. A notice that may have e errors
is split into e + 1 pieces; by the pigeonhole principle an occurrence with at most e errors
holds one of them unchanged. An Aho-Corasick automaton finds these seeds (and the exact phrases) in one
pass; around each seed the fuzzy matching of the `regex` library verifies the errors and gives
the span. Every whole text is searched; long texts cost time in proportion to their length.

Null and empty texts have no words and no labels, score 0. Repeated rows are scanned alike;
further columns stay, but columns named like a result are replaced.
"""

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from groundwork.llm import shared

#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices: (label, words, most errors in characters).
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "licensed under the gnu general public license", 4),
    ("gpl", "gnu lesser general public license", 3),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by", "licensed under a creative commons attribution license", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
)
_WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pieces(notice, errors):
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    cuts = [round(k * len(notice) / (errors + 1)) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def scanner(phrases, notices):
    """Automaton of phrases and seeds, and the fuzzy patterns; made once in each worker."""
    seeds = {}
    for text, label in phrases:
        seeds.setdefault(f" {text} ", []).append(("phrase", label, 0))
    patterns = []
    for number, (label, text, errors) in enumerate(notices):
        patterns.append((label, len(text), errors, regex.compile(f"(?b)(?<= )(?:{regex.escape(text)}){{e<={errors}}}(?= )")))
        for at, piece in pieces(text, errors):
            seeds.setdefault(piece, []).append(("seed", number, at))
    automaton = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    return automaton, patterns


def scan(text, phrases, notices):
    """(number of words, base places [(label, first word)], spans [(label, first word, last word, errors, likeness)]) of UTF-8 bytes."""
    words = _WORD.findall(text.lower())  # bytes.lower() touches A-Z only
    line = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte, so errors are counted in bytes
    automaton, patterns = scanner(phrases, notices)
    base, spans, tried, spaces = [], [], {}, []

    def word_at(place):
        """The word that begins at a place: spaces are listed once, then looked up."""
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32))
        return int(np.searchsorted(spaces[0], place)) - 1
    for end, (size, uses) in automaton.iter(line):
        for kind, what, at in uses:
            if kind == "phrase":
                base.append((what, word_at(end - size + 2)))
                continue
            label, length, errors, pattern = patterns[what]
            start = end - size + 1 - at
            if end < tried.get(what, 0):
                continue  # inside the span that was found last
            low, high = max(0, start - errors - 1, tried.get(what, 0)), min(len(line), start + length + 2 * errors + 1)
            found = pattern.search(line, low, high)
            if found:
                tried[what] = found.end()
                wrong = sum(found.fuzzy_counts)
                spans.append((label, word_at(found.start()), word_at(found.end()), wrong, 1 - wrong / length))
    return len(words), base, spans


def scanned(docs, phrases=PHRASES, notices=NOTICES):
    """The documents with n_words, n_base, first_word, last_word, base_labels, labels, score and `spans`."""
    phrases, notices = tuple(phrases.items()), tuple(notices)

    @F.arrow_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                 "spans array<struct<label: string, first_word: long, last_word: long, errors: int, likeness: double>>")
    def rows_of(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            n, base, spans = scan(text or b"", phrases, notices)
            places = [at for _, at in base]
            exact = {label for label, _ in base}
            rows.append({"n_words": n, "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
                         "base_labels": ",".join(sorted(exact)), "labels": ",".join(sorted(exact | {s[0] for s in spans})),
                         "score": 1.0 if base else max((s[4] for s in spans), default=0.0),
                         "spans": [dict(zip(("label", "first_word", "last_word", "errors", "likeness"), s)) for s in spans]})
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("likeness", pa.float64())])
        kind = pa.struct([(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()),
                         ("score", pa.float64()), ("spans", pa.list_(span))])
        return pa.array(rows, kind)

    out = docs.withColumn("__scan", rows_of.asNondeterministic()(F.col("text").cast("string").cast("binary")))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    return shared.with_columns(out, {n: F.col(f"__scan.{n}") for n in names}).drop("__scan")


def op5_license_scan(spark, sf_dir):
    docs = shared.documents(shared.table(spark, sf_dir, "documents"))
    return scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES = {}
