"""N-gram Jaccard join: MinHash prefixes of a fixed depth in place of an LSH forest, then exact verification.

1. Texts with the same set of word 5-grams are one class; everything after works on classes.
2. Each class has a signature of `TREES` runs of MinHash values. How long a prefix may be at the target
   recall follows from the threshold and the number of trees alone (`stop_depth`), so every run is cut
   there beforehand: classes with an equal prefix in any tree are candidates. Nothing is sorted, and no prefix
   is shortened from the data. A group of equal prefixes holds all longer matches too.
3. Nodes are not opened into pairs. Each class is tied to the least class of its node, and the connected
   components of these ties are verified exactly, in blocks: a component of n classes is cut into
   blocks of bounded size, each pair of blocks is a cell of its own, and a cell counts common shingles of
   all its pairs at once. It returns one row per class (number of linked documents, a link of a
   spanning forest), so no stage has a row per pair, and every pair is compared in one cell only.
4. Groups are the components of the verified links.

Words are as in `words`; a text of one to four words has one shingle, all its words. Null and
empty texts have no shingles and no links. A document row's copies count as links. Rows with equal
ids and texts are copies of each other. class_id is the smallest id in the group; null if all
its ids are null. Further columns are not read, and kept by `first_of_groups` as they are.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwork.llm import shared
from groundwork.llm.components import components
from groundwork.llm.words import Words, grams, mix, raw, slices

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 10
TARGET_RECALL = 0.9999
#: A block of a cell holds about so many classes and shingles at most.
BLOCK_CLASSES = 384
BLOCK_SHINGLES = 1 << 18
SEED = 0x5DEECE66D


def stop_depth(threshold=THRESHOLD, trees=TREES, deepest=MAX_DEPTH, target=TARGET_RECALL):
    """The longest prefix that two texts of the threshold's likeness share in some tree with the target probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def shingle_sets(data, offsets):
    """Sorted distinct shingle hashes of each row of a slice."""
    words = Words(data, offsets)
    hashes = words.hashes()
    every = grams(hashes, SHINGLE)
    sets = []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if last - first >= SHINGLE:
            sets.append(np.unique(every[first:last - SHINGLE + 1]))
        else:
            sets.append(grams(hashes[first:last], last - first) if last > first else np.zeros(0, np.uint64))
    return sets


def set_id(shingles):
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def prefix_keys(sets, trees, depth):
    """For rows with shingles: a key of the trie node at `depth` for each tree, rows x trees."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    factors = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
    keys = np.zeros((trees, len(sets)), np.uint64)
    for tree in range(trees):
        keys[tree] = mix(np.full(1, tree + 1, np.uint64))[0]
        for level in range(depth):
            least = np.minimum.reduceat(values * factors[tree * depth + level], starts)
            keys[tree] = mix(keys[tree] ^ least) + np.uint64(level)
    return keys.T.astype(np.int64)


def _text_columns(docs):
    docs = shared.documents(docs)
    return docs.withColumn("thash", F.xxhash64("text"))


def signatures(docs, trees=TREES, depth=None):
    """A row per document: doc_id, thash (hash of the text), n shingles, cid (class), keys."""
    depth = depth or stop_depth()

    def signed(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            sizes, ids, keys = [], [], []
            for first, last in slices(offsets):
                sets = shingle_sets(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                full = [s for s in sets if len(s)]
                found = iter(prefix_keys(full, trees, depth) if full else ())
                sizes += [len(s) for s in sets]
                ids += [set_id(s) for s in sets]
                keys += [next(found) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("thash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "thash", "n", "cid", "keys"])
    return _text_columns(docs).mapInArrow(signed, "doc_id long, thash long, n long, cid binary, keys array<long>")


def candidate_components(classes):
    """(cid, part): classes that share a trie node, directly or over others, have one part."""
    nodes = classes.select("cid", F.explode("keys").alias("key"))
    heads = shared.stage(nodes.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))  # a hot node can then be split
    ties = nodes.join(heads, "key").filter("cid != head").select(F.col("cid").alias("a"), F.col("head").alias("b"))
    return components(ties.distinct()).select(F.col("node").alias("cid"), F.col("label").alias("part"))


def cells(docs, classes):
    """(cell, part, i, j, side, cid, n_docs, shingles): each class once per cell that compares it."""
    parts = shared.stage(candidate_components(classes).join(classes.select("cid", "rep", "n", "n_docs"), "cid"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    sizes = sizes.select("part", F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks"), "s")
    bins = -(-(sizes.filter("blocks = 1").agg(F.sum("s").alias("s")).first()["s"] or 0) // BLOCK_SHINGLES) or 1
    members = parts.join(sizes.drop("s"), "part").select(
        F.col("rep.doc_id").alias("rep_id"), F.col("rep.thash").alias("rep_thash"), "cid", "part", "blocks", "n_docs", F.pmod(F.xxhash64("cid"), "blocks").alias("block"))
    texts = _text_columns(docs)
    found = texts.join(members, texts.doc_id.eqNullSafe(F.col("rep_id")) & (texts.thash == F.col("rep_thash"))).drop("doc_id", "thash", "rep_id", "rep_thash")

    def with_shingles(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            sets = [s for first, last in slices(offsets) for s in shingle_sets(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], [*names, "shingles"])
    kinds = [f"{name} {kind}" for name, kind in found.dtypes if name != "text"]
    found = found.mapInArrow(with_shingles, ", ".join([*kinds, "shingles array<long>"]))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(bins))).otherwise(F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other")))
    return found.select(place.alias("cell"), "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "n_docs", "shingles")


def common(values, owner, n, rows, columns):
    """Numbers of values that the owners in `rows` and in `columns` have in common, as a matrix."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1  # only shared values count
    owner, number = owner[often], number[often]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    width = max(1024, (1 << 21) // n)
    total = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(number.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(number, (low, low + width))
        has = np.zeros((n, min(width, int(number[b - 1]) - low + 1)), np.float32)
        has[owner[a:b], number[a:b] - low] = 1
        total += has[rows] @ has[columns].T
    return total


def linked(sets, sides, across, weights, threshold):
    """Per class: number of documents linked to it in this cell, and the first class it hangs together with."""
    n = len(sets)
    rows = np.flatnonzero(sides == sides.min()) if across else np.arange(n)
    columns = np.flatnonzero(sides != sides.min()) if across else rows
    size = np.array([len(s) for s in sets], np.float64)
    both = common(np.concatenate(sets), np.repeat(np.arange(n), size.astype(int)), n, rows, columns).astype(np.float64)
    close = both * (1 + threshold) >= threshold * (size[rows][:, None] + size[columns][None, :]) - 1e-9
    near = np.zeros((n, n), bool)
    near[np.ix_(rows, columns)] = close
    near |= near.T
    np.fill_diagonal(near, False)
    counts = near @ weights
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == label).all():
            return counts, label
        label = least


def verify(cell_rows, threshold=THRESHOLD):
    """(cid, n_linked, head): exact links of each cell, and one class of the same group."""
    def verified(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cids = table.column("cid").to_pylist()
        keys = list(zip(*(table.column(c).to_pylist() for c in ("part", "i", "j"))))
        lists = table.column("shingles").combine_chunks()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        blocks, weights = table.column("block").to_numpy(), table.column("n_docs").to_numpy()
        parts = {}
        for at, key in enumerate(keys):
            parts.setdefault(key, {}).setdefault(cids[at], at)  # a class that came twice counts once
        out = []
        for (_, i, j), members in parts.items():
            at = np.array([members[c] for c in sorted(members)])
            if len(at) < 2 or (i != j and len(set(blocks[at])) < 2):
                continue
            counts, label = linked([values[offsets[k]:offsets[k + 1]] for k in at], blocks[at], i != j, weights[at], threshold)
            out += [(cids[k], int(c), cids[at[h]]) for k, c, h in zip(at, counts, label) if c]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.binary(), pa.int64(), pa.binary()))], names=["cid", "n_linked", "head"])
    return cell_rows.groupBy("cell").applyInArrow(verified, "cid binary, n_linked long, head binary")


def grouped(docs, threshold=THRESHOLD):
    """A row per document row: doc_id, thash, n_shingles, class_id, n_links, and whether it is the first of its group."""
    rows = shared.stage(signatures(docs, depth=stop_depth(threshold)))
    # The class's first row stands for it: smallest id, null ids last.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")
    classes = shared.stage(rows.filter("n > 0").groupBy("cid").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    links = shared.stage(verify(cells(docs, classes), threshold))
    counts = links.groupBy("cid").agg(F.sum("n_linked").alias("n_linked"))
    groups = components(links.filter("cid != head").select(F.col("cid").alias("a"), F.col("head").alias("b")))
    member = groups.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    heads = member.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("lead"))
    in_groups = groups.join(heads, "label").select(F.col("node").alias("cid"), F.col("lead.rep").alias("lead"), F.col("lead.node").alias("lead_cid"))
    # Classes of one row without links need no entry.
    info = classes.select("cid", "rep", "n_docs").join(in_groups, "cid", "left").join(counts, "cid", "left").filter("n_docs > 1 or lead is not null")
    info = info.select("cid", F.coalesce("lead", "rep").alias("lead"), F.coalesce("lead_cid", "cid").alias("lead_cid"), (F.col("n_docs") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "thash", "n", "cid").join(shared.stage(info), "cid", "left")
    is_first = F.col("lead").isNull() | ((F.col("lead_cid") == F.col("cid")) & F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("thash") == F.col("lead.thash")))
    return out.select("doc_id", "thash", F.col("n").alias("n_shingles"), F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), is_first.alias("is_first"))


def first_of_groups(docs, threshold=THRESHOLD):
    """The documents, all columns, without those that stand behind the first of their group; texts without words stay."""
    keys = grouped(docs, threshold).filter("is_first").groupBy(F.col("doc_id").alias("__id"), F.col("thash").alias("__thash")).agg(F.max("n_shingles").alias("__n"))
    docs = docs.withColumn("__text_hash", F.xxhash64(F.col("text").cast("string")))
    kept = docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__thash")))
    place = F.row_number().over(Window.partitionBy("__id", "__thash").orderBy(F.lit(0)))
    return kept.withColumn("__place", place).filter("__place = 1 or __n = 0").drop("__id", "__thash", "__text_hash", "__n", "__place")


def op7_jaccard_join(spark, sf_dir):
    return grouped(shared.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class_id", "n_links")


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES = {}
