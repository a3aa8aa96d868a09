"""Benchmark decontamination by winnowing.

Every window of `WINDOW` words has a fingerprint, the smallest hash of its word k-grams, and equal
windows have equal ones: so two texts that share a span of `WINDOW` words share a fingerprint, and
only windows whose fingerprint the test items have can match. A Bloom filter of the test
fingerprints, of a size fixed beforehand, drops nearly all document windows where they are read
(a full filter only drops fewer); the rest are joined on fingerprint and a digest of the whole
window, so every window stands for itself: prints are not thinned to one a minimum, and no hit is
extended from one. Windows that match and overlap are one span of hit words.

An item of fewer words is one window of its own size; each such size that occurs is looked for with
k-grams to fit, so the guarantee holds for it too. The test items and the hits are tables: no
list of items or fingerprints is held by the driver, and a window that very many documents share
is a hot key on one side of a join only, which Spark splits.

Null and empty texts have no words: such documents have no hits, such items no windows. Items
with one id are one item; a null item id counts as ''. Each document row gives one row, repeated
ids too. Other columns of the inputs are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared
from groundwork.llm.words import Words, grams, raw, slices

WINDOW = 10
GRAM = 5
#: The filter has 16 bits for each test fingerprint, but 2 MB at most.
BLOOM_BITS = 1 << 24


def fingerprints(hashes, size, gram=GRAM):
    """The smallest k-gram hash of each window of `size` words, by the window's first word."""
    gram = min(gram, size)
    values = grams(hashes, gram)
    n = max(0, len(hashes) - size + 1)
    low = values[:n].copy()
    for k in range(1, size - gram + 1):
        np.minimum(low, values[k:k + n], out=low)
    return low


def _digest(words, first, size):
    return hashlib.blake2b(words.text(first, first + size), digest_size=16).digest()


def item_windows(items):
    """(item_id, size, fingerprint, window) of every window of every test item."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))

    def windows_of(batches):
        for batch in batches:
            ids, (data, offsets) = batch.column("item_id").to_pylist(), raw(batch.column("text"))
            rows = []
            for row, name in enumerate(ids):
                words = Words(data[offsets[row]:offsets[row + 1]], [0, offsets[row + 1] - offsets[row]])
                size = min(WINDOW, len(words.start))
                if size:
                    prints = fingerprints(words.hashes(), size).astype(np.int64)
                    rows += [(name, size, int(p), _digest(words, at, size)) for at, p in enumerate(prints)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                                             ["item_id", "size", "fingerprint", "window"])
    return items.mapInArrow(windows_of, "item_id string, size int, fingerprint long, window binary")


def bloom(prints, n):
    """Bits of a Bloom filter (two per fingerprint) as numbers of 32 bits; its size has a fixed limit."""
    bits = 1 << 10
    while bits < min(16 * n, BLOOM_BITS):
        bits *= 2
    places = F.explode(F.array(F.col("fingerprint").bitwiseAND(bits - 1), F.shiftrightunsigned("fingerprint", 32).bitwiseAND(bits - 1)))
    filled = prints.select(places.alias("place")).groupBy(F.shiftright("place", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 31))")).alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    for row in filled.collect():  # bits / 32 rows at most
        out[row["at"]] = row["bits"]
    return out


def may_hold(filter_bits, prints):
    mask = np.uint64(len(filter_bits) * 32 - 1)
    held = np.ones(len(prints), bool)
    for place in (prints & mask, (prints >> np.uint64(32)) & mask):
        held &= (filter_bits[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return held


def candidate_windows(docs, filters):
    """A row per document: rid, doc_id, thash (hash of the text), n_words, and its windows (start, size, fingerprint, window) that pass the filter of their size."""
    docs = shared.documents(docs).withColumn("rid", F.monotonically_increasing_id()).withColumn("thash", F.xxhash64("text"))
    filters = docs.sparkSession.sparkContext.broadcast(filters)
    window = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("fingerprint", pa.int64()), ("window", pa.binary())])

    def candidates_of(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            counts, found = [], []
            for first, last in slices(offsets):
                begin = offsets[first]
                words = Words(data[begin:offsets[last]], offsets[first:last + 1] - begin)
                hashes, row_of, hits = words.hashes(), words.row_of(), [[] for _ in range(last - first)]
                for size, bits in filters.value.items():
                    prints = fingerprints(hashes, size)
                    inside = row_of[:len(prints)] == row_of[size - 1:size - 1 + len(prints)]  # windows never span two documents
                    for at in np.flatnonzero(inside & may_hold(bits, prints)).tolist():
                        row = int(row_of[at])
                        hits[row].append((at - int(words.first[row]), size, int(prints[at].astype(np.int64)), _digest(words, at, size)))
                counts += np.diff(words.first).tolist()
                found += [[dict(zip(("start", "size", "fingerprint", "window"), h)) for h in row] for row in hits]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("thash"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(window))],
                                             ["rid", "doc_id", "thash", "n_words", "windows"])
    return docs.mapInArrow(
        candidates_of, "rid long, doc_id long, thash long, n_words long, windows array<struct<start: int, size: int, fingerprint: long, window: binary>>")


def hits(docs, items):
    """A row per document: rid, doc_id, thash, n_words, n_hit, items (sorted ids of items with occurring windows), spans (start, size)."""
    windows = shared.stage(item_windows(items).distinct())
    sizes = windows.groupBy("size").agg(F.countDistinct("fingerprint").alias("n")).collect()  # WINDOW rows at most
    filters = {row["size"]: bloom(windows.filter(F.col("size") == row["size"]).select("fingerprint").distinct(), row["n"]) for row in sizes}
    rows = shared.stage(candidate_windows(docs, filters))
    # Which windows occur and which items hold them are two joins: a window of very many items is no list, and a hot row of either side can be split.
    key = ["fingerprint", "window", "size"]
    matched = shared.stage(rows.select("rid", F.explode("windows").alias("w")).select("rid", "w.*").join(shared.stage(windows.select(*key).distinct()), key))
    of_items = matched.select("rid", *key).join(windows, key).select("rid", "item_id").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = matched.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans")).join(of_items, "rid")
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def covered(acc, span):
        end = (span.start + span["size"]).cast("long")
        return F.struct((acc.n + F.greatest(F.lit(0).cast("long"), end - F.greatest(span.start.cast("long"), acc.reach))).alias("n"), F.greatest(acc.reach, end).alias("reach"))
    found = found.withColumn("n_hit", F.aggregate("spans", nothing, covered, lambda acc: acc.n))
    none = F.array().cast("array<string>")
    return rows.drop("windows").join(found, "rid", "left").select(
        "rid", "doc_id", "thash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")


def clean(docs, items):
    """The documents, all columns as they are, without a hit. Only the hits' keys (id and hash of the text) are joined."""
    text = F.xxhash64(F.col("text").cast("string"))
    found = hits(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("thash").alias("__thash")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text == F.col("__thash")), "left_anti")


def op3_decontaminate(spark, sf_dir):
    found = hits(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op3_decontaminate": op3_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {"op3_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, s, array_to_string(w[s:s + size - 1], ' ') AS g
       FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT rid, s, dw.size, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
p AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS place FROM m) GROUP BY rid),
n AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN n USING (rid)
"""}
