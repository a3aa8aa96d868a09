"""Small tables with every awkward case, and plain versions of what the operators define."""

import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASHES = ("kept", "rule", "n_words", "score", "predicted", "labels", "rid", "thash", "cid", "keys", "gram", "name", "k1", "runs",
           "windows", "items", "class_id", "epoch", "key", "bucket", "budget", "left", "tokens", "part", "cell")


def words(text):
    return WORD.findall((text or "").encode().lower())


def documents(spark, rows):
    """Rows of (doc_id, text) or of whole documents."""
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCS)


def clashing(docs):
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit("other").alias(name) for name in CLASHES])


def awkward(spark):
    """Null, empty, blank, very long, repeated and equal rows, null ids."""
    long = " ".join(f"w{k % 997}x{k % 31}" for k in range(40_000))
    text = " ".join(f"alpha{k} beta{k % 7} gamma" for k in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, text), (5, text), (6, text), (None, text), (None, None), (7, "ünï " * 80), (8, "a")]
    return documents(spark, [r + ("en", "src0", 1) for r in rows])


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=repr)
