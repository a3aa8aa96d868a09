"""Grouping of spelling variants: words one edit apart, found by comparing dense tiles of code points.

1. Words. Runs of `[A-Za-z\\u00C0-\\u00FF]` are counted for each text and summed in each task before they are
   shuffled. A seeded misspelling (see `noisy`) takes a code point out of about one of `NOISE` (document, run) pairs.
2. Halves. Two words one edit apart share, with m the length of the shorter, the first m // 2 code points or the
   last m - m // 2. A word takes part in four such groups, as the shorter word and as the longer.
3. Tiles. The words of a group stand in two matrices of code points, padded at the right and at the left. Blocks are
   compared with blocks, position by position: where common prefix plus common suffix reach the longer length
   minus one, the words are one edit apart. Small groups share a tile; a group of over `BLOCK` words is cut into blocks,
   and each pair of blocks is a cell of its own, so no task holds a whole group. A tile returns the number of near words
   and the best of them for each word, not the pairs. A pair is counted in the group of its common first half, and in that
   of its last half only if the first halves differ, hence once.
4. Forms. A word's form is its near word of largest n (ties: smallest in code-point order) if that is `RATIO` times
   the word's own; roots follow forms by pointer jumps over staged tables, at most as often as n can grow.

Null and empty texts have no words; a null id counts as ''. Repeated rows count again. Words of any length are
compared whole. Columns other than doc_id and text are not read. Tables without rows give no rows.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOISE = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Words of a block; a cell holds two blocks at most.
BLOCK = 4096
#: A tile compares so many rows with so many, and packed small groups fill about so many rows.
TILE = 1024
PACK = 128
#: Code points of a side of a tile at most, so very long words make narrow tiles.
TILE_POINTS = 1 << 20
#: Rows of a cell of small groups, about.
CELL_ROWS = 1 << 15
#: Different words a task counts before it hands them on.
FLUSH = 1 << 18


def noisy(run, seed, noise=NOISE):
    """The run without its code point h % length where `noise` divides h, the crc32 of `<doc_id>:<run>`; `seed` is that of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), seed)
    if h % noise:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs, noise=NOISE, min_length=MIN_LENGTH, min_count=MIN_COUNT):
    """(word, n) of the words of all texts that are long and frequent enough."""
    rows = shared.documents(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def counted(batches):
        total = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(RUN.findall((text or b"").lower().decode())).items():  # bytes.lower() lowers A-Z only
                    if len(run) >= min_length:
                        word = noisy(run, seed, noise)
                        if len(word) >= min_length:
                            total[word] += n
                if len(total) > FLUSH:
                    yield batch_of(total)
                    total = Counter()
        yield batch_of(total)

    def batch_of(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def halves(words):
    """(word, n, m, side, bucket): the groups of each word, by the shorter length m and the first (0) or last (1) half."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0")
    half = F.expr("m div 2").cast("int")
    rows = rows.select("word", "n", "m", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")),
                                                           F.struct(F.lit(1).alias("side"), F.right("word", F.col("m") - half).alias("part")))).alias("h"))
    return rows.select("word", "n", "m", F.col("h.side").alias("side"), F.xxhash64("m", "h.side", "h.part").alias("bucket"))


def cells(rows, block=BLOCK):
    """Groups of two words or more with the cells that compare them: (cell, bucket, i, j, block, m, side, word, n)."""
    sizes = shared.stage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / block)))
    small = sizes.filter("blocks = 1").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    found = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("word"), "blocks"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    cell = F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(max(1, -(-small // CELL_ROWS))))).otherwise(F.xxhash64("bucket", i, j))
    return found.select(cell.alias("cell"), "bucket", i.alias("i"), j.alias("j"), "block", "m", "side", "word", "n")


def padded(words, right):
    """A row of code points for each word, as wide as the longest; the rest is -1, at the right or at the left."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), int(lengths.max())), -1, np.int32)
    column = np.arange(out.shape[1])
    filled = column < lengths[:, None] if right else column >= (out.shape[1] - lengths)[:, None]
    out[filled] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


def common(a, b):
    """Length of the common prefix of each row of `a` with each row of `b`."""
    total, alive = np.zeros((len(a), len(b)), np.int32), np.ones((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        alive &= a[:, k][:, None] == b[:, k][None, :]
        if not alive.any():
            break
        total += alive
    return total


def near(words, group, m, side, second=None):
    """Pairs (rows, columns) of words one edit apart, each pair once, among words of one group; `second` marks the words of a second block, which only meet those of the first.

    A padding equals only padding, so equal words alone could run on into it, and words are different.
    """
    left, back = padded(words, True), np.ascontiguousarray(padded(words, False)[:, ::-1])
    lengths = np.array([len(w) for w in words], np.int64)
    step = max(1, min(TILE, TILE_POINTS // left.shape[1]))
    one, two = (np.arange(len(words)),) * 2 if second is None else (np.flatnonzero(~second), np.flatnonzero(second))
    for a in range(0, len(one), step):
        for b in range(a if second is None else 0, len(two), step):
            r, c = one[a:a + step], two[b:b + step]
            prefix, suffix = common(left[r], left[c]), common(back[r], back[c])
            longer, shorter = np.maximum(lengths[r][:, None], lengths[c][None, :]), np.minimum(lengths[r][:, None], lengths[c][None, :])
            hit = (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (group[r][:, None] == group[c][None, :])
            hit &= (m[r][:, None] == shorter) & (m[c][None, :] == shorter) & (side[r][:, None] == side[c][None, :])
            hit &= np.where(side[r][:, None] == 0, prefix >= shorter // 2, prefix < shorter // 2)
            if second is None:
                hit &= r[:, None] < c[None, :]
            x, y = np.nonzero(hit)
            yield r[x], c[y]


def _tiles(group, width, alone):
    """Ranges of rows, sorted by group, that are compared together: small groups are packed up to PACK rows, groups of two blocks stand alone."""
    edges = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)].tolist()
    first = 0
    for at, end in zip(edges[1:], [*edges[2:], None]):
        if end is None or end - first > PACK or width[at] > 2 * width[first] or alone[first] or alone[at]:
            yield first, at
            first = at


def best_near(cell_rows):
    """(word, n_near, form_n, form) of each cell: how many near words it holds and the best of them."""
    def compared(table: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("m", "bucket", "i", "j", "side", "word")]
        table = table.sort_by(order).combine_chunks()
        words = table.column("word").to_pylist()
        bucket, i, j, block, m, side, n = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "m", "side", "n"))
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (m[1:] != m[:-1]) | (side[1:] != side[:-1])]
        group, across = np.cumsum(new), i != j
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
        by_rank = np.argsort(rank)
        times, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
        for first, last in _tiles(group, m, across):
            if last - first < 2:
                continue
            part = slice(first, last)
            for x, y in near(words[part], group[part], m[part], side[part], (block == j)[part] if across[first] else None):
                for a, b in ((x + first, y + first), (y + first, x + first)):
                    np.add.at(times, a, 1)
                    np.minimum.at(best, a, rank[b])
        found = np.flatnonzero(times)
        form = by_rank[best[found]]
        return pa.table([pa.array([words[k] for k in found], pa.string()), pa.array(times[found]), pa.array(n[form], pa.int64()), pa.array([words[k] for k in form], pa.string())],
                        names=["word", "n_near", "form_n", "form"])
    rows = cell_rows.groupBy("cell").applyInArrow(compared, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms):
    """(word, root) for (word, form): forms followed to the last, twice as far in each round. n grows by each form, so there is no circle."""
    jumps = shared.stage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = shared.stage(jumps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not jumps.filter("moved").limit(1).count():
            return jumps.select("word", "root")
        jumps = jumps.select("word", "root")


def variants(words, ratio=RATIO, block=BLOCK):
    """A row per word of (word, n): word, form, root, n, n_near, form_n."""
    words = shared.stage(words)
    found = shared.stage(words.join(best_near(cells(halves(words), block)), "word", "left"))
    is_form = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    return found.join(roots(found.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return variants(word_counts(shared.table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}

#: The 64 letters beyond ASCII, and a single byte for each, so that edits of bytes are edits of code points.
_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~"

ORACLES = {"op13_spelling_variants": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') AS id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+') AS runs FROM documents),
r AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(runs) AS run FROM d) WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
-- crc32: a table of 256 remainders, then a step for each byte.
t AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) AS h FROM b, t),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
m AS MATERIALIZED (SELECT word, n, length(word) AS len, translate(word, '{_LETTERS}', '{_BYTES}') AS s FROM v),
p AS (SELECT a.word, b.word AS other, b.n FROM m a JOIN m b ON b.len = a.len WHERE a.word <> b.word AND levenshtein(a.s, b.s) = 1
  UNION ALL SELECT a.word, b.word, b.n FROM m a JOIN m b ON b.len = a.len + 1 WHERE levenshtein(a.s, b.s) = 1
  UNION ALL SELECT b.word, a.word, a.n FROM m a JOIN m b ON b.len = a.len + 1 WHERE levenshtein(a.s, b.s) = 1),
g AS (SELECT word, count(*) AS n_near, first(struct_pack(other := other, n := n) ORDER BY n DESC, other) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {RATIO} * v.n THEN best.other END AS form, CASE WHEN best.n >= {RATIO} * v.n THEN best.n END AS form_n FROM v LEFT JOIN g ON g.word = v.word),
w AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT w.word, w.further, f.form FROM w JOIN f ON f.word = w.further)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.further IS NULL
"""}
