"""Removal of lines that many documents share, by two Bloom filters and an exact count of what they suspect.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. A document counts a key once.

1. Filters. Every task marks the places of its keys in two bit sets, "seen" and "seen again", and returns
   the chunks it has touched. Chunks merge as counters that stop at two: a place set in two tasks, or
   twice in one, is set in the second filter. So a key of two documents always passes that filter; one
   of a single document passes it by chance only. Their size is fixed beforehand (`BLOOM_BITS`, 8 MB each).
2. Exact counts. Only keys that pass are counted, by a 128-bit digest, summed in each task before the shuffle.
   Corpora with more different lines than the filter holds pass more of them: the counts stay exact, and
   what is shuffled stays a few bytes for each different line of a task.
3. Removal. The digests found often enough are broadcast if they are `BROADCAST_LINES` at most. Otherwise
   suspected (text, digest) pairs are joined with them, gathered for each text, and joined with the texts.

`least` documents make a line repeated. With `keep_first` the first of its lines stays, in the document of the
smallest id (null ids last; of equal ids, the smaller text hash); rows with equal id and text are alike.
Null and empty texts are one empty line. Keys shorter than `shortest` code points always stay. Each row gives one
row, and each row counts as a document, repeated ones too. `drop_lines` keeps all columns of its input.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from groundwork.llm import shared

LEAST = 10
SHORTEST = 1
#: Bits of each filter; with two places a key, 8 MB hold about ten million keys well.
BLOOM_BITS = 1 << 26
#: Filters travel in chunks of so many bits.
CHUNK = 1 << 16
#: Digests that may be broadcast, of 16 bytes and a place of 8: 3 MB.
BROADCAST_LINES = 1 << 17
#: Rows a task holds before it hands them on.
FLUSH = 1 << 17
SPACE = b" \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACE).lower()


def keys(text, shortest=SHORTEST):
    """Distinct keys of a text's lines (bytes) that may go."""
    found = {key(line) for line in text.split(b"\n")}
    return [k for k in found if len(k) >= shortest and (shortest <= 1 or len(k.decode()) >= shortest)]


def digests(found):
    """128-bit digests of keys as an array of two 64-bit numbers a row."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), dtype="<u8").reshape(-1, 2)


def places(digest, bits):
    """The two places of each key in a filter."""
    mask = np.uint64(bits - 1)
    return np.stack([digest[:, 0] & mask, (digest[:, 0] >> np.uint64(32)) & mask], axis=1).astype(np.int64)


def _set(filter_bytes, at):
    """Set sorted distinct places in a packed filter."""
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        filter_bytes[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)


def _has(filter_bytes, at):
    return (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Seen:
    """Two packed filters of a task or of all: places seen, and places seen again."""

    def __init__(self, bits):
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, digest):
        """Digests with a row for each document that has the key."""
        both = np.sort(places(digest, len(self.once) * 8), axis=1)
        both = np.concatenate([both[:, 0], both[both[:, 0] != both[:, 1], 1]])  # a key counts a place once
        at, times = np.unique(both, return_counts=True)
        _set(self.twice, at[(times > 1) | _has(self.once, at)])
        _set(self.once, at)

    def merge(self, once, twice):
        self.twice |= twice | (self.once & once)
        self.once |= once

    def holds(self, digest):
        at = places(digest, len(self.twice) * 8)
        return _has(self.twice, at[:, 0]) & _has(self.twice, at[:, 1])


def _packed(part):
    """A chunk as places if they are few, else as bits."""
    at = np.flatnonzero(np.unpackbits(part, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < len(part) else part.tobytes()


def _unpacked(data, bits):
    if len(data) == bits // 8:
        return np.frombuffer(data, np.uint8)
    at, out = np.frombuffer(data, "<u2").astype(np.int64), np.zeros(bits // 8, np.uint8)
    _set(out, at)
    return out


def seen_again(docs, shortest=SHORTEST, bits=BLOOM_BITS):
    """The filter of keys that two documents or more have, as bytes; it is as large for any input."""
    size = min(CHUNK, bits)

    def marked(batches):
        seen = Seen(bits)
        for batch in batches:
            found = [k for text in batch.column("text").to_pylist() for k in keys(text or b"", shortest)]
            for first in range(0, len(found), FLUSH):
                seen.add(digests(found[first:first + FLUSH]))
        width = size // 8
        used = np.flatnonzero(seen.once.reshape(-1, width).any(axis=1)).tolist()
        for first in range(0, len(used), 64):
            part = used[first:first + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([_packed(f[c * width:(c + 1) * width]) for c in part], pa.binary()) for f in (seen.once, seen.twice))],
                                             ["chunk", "once", "twice"])

    def merged(batches):
        held = {}  # of the chunks of this task: it is as large for any number of tasks before it
        for batch in batches:
            for chunk, once, twice in zip(*(batch.column(c).to_pylist() for c in ("chunk", "once", "twice"))):
                held.setdefault(chunk, Seen(size)).merge(_unpacked(once, size), _unpacked(twice, size))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([seen.twice.tobytes() for seen in held.values()], pa.binary())], ["chunk", "twice"])

    chunks = _bytes_of(docs).select("text").mapInArrow(marked, "chunk int, once binary, twice binary").repartition("chunk").mapInArrow(merged, "chunk int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in chunks.collect():  # bits / 8 bytes at most
        out[row["chunk"] * size // 8:(row["chunk"] + 1) * size // 8] = np.frombuffer(row["twice"], np.uint8)
    return out


def _bytes_of(docs):
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.cast("binary").alias("text"))


def _suspects(batch, filled, shortest):
    """Per row of a batch its keys' digests that pass the filter."""
    found = [keys(text or b"", shortest) for text in batch.column("text").to_pylist()]
    digest = digests([k for row in found for k in row])
    row_of = np.repeat(np.arange(len(found)), [len(row) for row in found])
    passed = filled.holds(digest)
    return digest[passed], row_of[passed]


def repeated(docs, twice, least=LEAST, shortest=SHORTEST):
    """(h1, h2, n, place): digests of the keys of `least` documents or more, and the place whose first line `keep_first` keeps."""
    twice = docs.sparkSession.sparkContext.broadcast(twice)

    def counted(batches):
        filled = Seen(8)
        filled.twice = twice.value
        for batch in batches:
            digest, row_of = _suspects(batch, filled, shortest)
            ids, k1, k2 = (batch.column(c) for c in ("doc_id", "k1", "k2"))
            rank = np.empty(batch.num_rows, np.int64)
            rank[np.lexsort((k2.to_numpy(), k1.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(batch.num_rows)
            order = np.lexsort((rank[row_of], digest[:, 1], digest[:, 0]))
            digest, row_of = digest[order], row_of[order]
            first = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(axis=1)]) if len(digest) else np.zeros(0, np.int64)
            at = pa.array(row_of[first], pa.int64())
            yield pa.RecordBatch.from_arrays([*_halves(digest[first]), pa.array(np.diff(np.r_[first, len(digest)]), pa.int64()), *(c.take(at) for c in (ids, k1, k2))],
                                             ["h1", "h2", "n", "doc_id", "k1", "k2"])
    rows = _bytes_of(docs).mapInArrow(counted, "h1 long, h2 long, n long, doc_id long, k1 long, k2 long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    rows = rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), first.alias("at")).filter(F.col("n") >= least)
    return rows.select("h1", "h2", "n", F.xxhash64("at.doc_id", "at.k1", "at.k2").alias("place"))


def _halves(digest):
    return [pa.array(np.ascontiguousarray(digest[:, side]).view(np.int64), pa.int64()) for side in (0, 1)]


def _gathered(docs, bad, twice, shortest):
    """(k1, k2, bad): the repeated keys of each text that has any, found by joins; no more than the text has lines."""
    twice = docs.sparkSession.sparkContext.broadcast(twice)

    def paired(batches):
        filled = Seen(8)
        filled.twice = twice.value
        for batch in batches:
            digest, row_of = _suspects(batch, filled, shortest)
            at = pa.array(row_of, pa.int64())
            yield pa.RecordBatch.from_arrays([*_halves(digest), batch.column("k1").take(at), batch.column("k2").take(at)], ["h1", "h2", "k1", "k2"])
    pairs = _bytes_of(docs).mapInArrow(paired, "h1 long, h2 long, k1 long, k2 long").distinct()
    return pairs.join(bad.select("h1", "h2", "place"), ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2", "place")).alias("bad"))


def _without(text, known, place, shortest):
    """(lines, dropped lines, text without the lines of known keys); of a key whose place this is the first line stays."""
    lines, kept, held = text.split(b"\n"), [], set()
    for line in lines:
        k = key(line)
        first = known.get(xxhash.xxh3_128_digest(k), known) if len(k) >= shortest and (shortest <= 1 or len(k.decode()) >= shortest) else known
        if first is known:
            kept.append(line)
        elif place is not None and first == place and k not in held:
            held.add(k)
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _judged(docs, least, shortest, keep_first, bits, most):
    """The documents with `__l`: numbers of lines and dropped lines, and the text that is left."""
    twice = seen_again(docs, shortest, bits)
    bad = shared.stage(repeated(docs, twice, least, shortest))
    kinds = (pa.int64(), pa.int64(), pa.binary())

    def made(rows):
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, kinds)], ["n_lines", "n_dropped", "text"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__k1", F.xxhash64(text)).withColumn("__k2", F.xxhash64(F.lit("second"), text))
    place = F.xxhash64(F.col("doc_id").cast("long"), F.col("__k1"), F.col("__k2")) if keep_first else F.lit(None).cast("long")
    if bad.limit(most + 1).count() <= most:
        few = bad.select("h1", "h2", "place").toArrow()  # `most` rows of 24 bytes
        held = docs.sparkSession.sparkContext.broadcast((_bytes(few), few.column("place").to_pylist()))
        built = {}

        @F.arrow_udf("n_lines long, n_dropped long, text binary")
        def worked(texts: pa.Array, places: pa.Array) -> pa.Array:
            if not built:
                built["known"] = dict(zip(*held.value))
            return made([_without(t or b"", built["known"], p, shortest) for t, p in zip(texts.to_pylist(), places.to_pylist())])
        return keyed.withColumn("__l", worked.asNondeterministic()(text.cast("binary"), place)).drop("__k1", "__k2")

    @F.arrow_udf("n_lines long, n_dropped long, text binary")
    def joined(texts: pa.Array, places: pa.Array, bads: pa.Array) -> pa.Array:
        rows = []
        for t, p, found in zip(texts.to_pylist(), places.to_pylist(), bads.to_pylist()):
            known = {np.array([b["h1"], b["h2"]], np.int64).tobytes(): b["place"] for b in found or ()}
            rows.append(_without(t or b"", known, p, shortest))
        return made(rows)
    found = shared.stage(_gathered(docs, bad, twice, shortest)).select(F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("bad").alias("__bad"))
    rows = keyed.join(found, (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")), "left")
    return rows.withColumn("__l", joined.asNondeterministic()(text.cast("binary"), place, "__bad")).drop("__k1", "__k2", "__a", "__b", "__bad")


def _bytes(table):
    """Digests as 16 bytes each."""
    both = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1).astype(np.int64)
    return [both[k].tobytes() for k in range(len(both))]


def line_counts(docs, least=LEAST, shortest=SHORTEST, keep_first=False, bits=BLOOM_BITS, most=BROADCAST_LINES):
    """A row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    rows = _judged(shared.documents(docs), least, shortest, keep_first, bits, most)
    return rows.select("doc_id", F.col("__l.n_lines").alias("n_lines"), F.col("__l.n_dropped").alias("n_dropped"), F.sha2("__l.text", 256).alias("kept_sha256"))


def drop_lines(docs, least=LEAST, shortest=SHORTEST, keep_first=False, bits=BLOOM_BITS, most=BROADCAST_LINES):
    """The documents, all columns, without the repeated lines of `text`; null stays null."""
    rows = _judged(docs, least, shortest, keep_first, bits, most)
    text = F.when(F.col("text").isNotNull(), F.col("__l.text").cast("string"))
    return shared.with_columns(rows, {"text": text}).select(*docs.columns)


def op11_line_dedup(spark, sf_dir):
    return line_counts(shared.table(spark, sf_dir, "documents"))


QUERIES = {"op11_line_dedup": op11_line_dedup}

ORACLES = {"op11_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM (SELECT DISTINCT rid, key FROM k WHERE length(key) >= {SHORTEST}) GROUP BY key HAVING count(*) >= {LEAST}),
j AS (SELECT k.*, bad.key IS NOT NULL AS gone FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""}
