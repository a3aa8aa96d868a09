"""Removal of long repeated strings by sorting sampled suffixes, after the manner of difference covers.

A string of `SPAN` bytes that stands at two places goes, wherever it stands. Sorting every suffix of
the corpus is out of reach (see README), so suffixes are sampled, sorted and merged:

1. Sample. Of each window of `SPAN` bytes the place with the least hash of `GRAM` bytes is sampled. Like the
   residues of a difference cover, the sample has for any two equal windows a place at the same
   offset in both, but it takes one of about 180 places instead of two of three.
2. Names. A sampled place and the windows it was chosen by are one segment; segments are named by
   their bytes and counted. A place whose gram occurs once has no repeat at all and goes no further; a
   name that occurs twice repeats in whole. What is left are places near an edge of a repeat.
3. Bytes. Of each segment whose gram has such places, one place's bytes are read, through a join of the
   places with the texts. That is the only move of texts besides the last join; no list is held anywhere.
4. Sort and merge. The segments of a gram are sorted by what follows the sampled place. Neighbours with the
   longest common start are merged first, small into large, and each segment is compared with the nearest
   by what precedes the place: no other segment with as long a common start agrees further back. So the
   matches found are all there are, at m log m comparisons for m segments.
5. A gram whose segments fill more than `RANGE_BYTES` is sorted in ranges, once by what follows and once by
   what precedes, and merged in each range. Windows that could match beyond the ends of both their ranges
   and matched nothing inside are the remaining suffixes: each is its offset and a digest of its bytes, grouped
   with the same offsets of that gram's segments, at most one row a window.

Several lengths can be asked for at once: windows of the shortest choose the sampled places, and segments
reach as far as the longest needs, so one sample and one merge find the matches of every length.

Everything is judged on the texts as they come. Texts are keyed by a 128-bit hash: equal texts get equal cuts.
Names are 64 bits beside the 64 of their gram. Null is empty; texts shorter than SPAN lose bytes to nothing. Each row gives one row. Rows whose text
repeats count as further places. `cut` keeps all columns of its input.
"""

import hashlib
from bisect import bisect_left, insort
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared
from groundwork.llm.words import Powers, mix, raw

SPAN = 400
GRAM = 32
#: Shortest repeated string that the query counts beside those of `SPAN`: fifty words of four letters and a space, as the pipeline's stage takes it.
PASSAGE = 250
#: Segments of a gram that one task may hold, and the size of the ranges of larger grams, in bytes.
RANGE_BYTES = 16 << 20


def window_minima(values, width):
    """Smallest value of each run of `width` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def sample(data, span=SPAN, gram=GRAM):
    """(gram hash, sampled place, first and last window that chose it) of a text of at least `span` bytes, in order."""
    up, down = Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])
    width = span - gram + 1
    least = window_minima(hashes, width)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    for first, last in zip([0, *change.tolist()], [*(change - 1).tolist(), len(least) - 1]):
        place = first + int(hashes[first:first + width].argmin())
        while place < last:  # the same gram again within reach: windows beyond the first take the next
            yield least[first], place, first, place
            first = place + 1
            place = first + int(hashes[first:first + width].argmin())
        yield least[first], place, first, last


def _texts(docs):
    """Distinct keys of texts are 128 bits: two hashes of different seeds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.alias("text"))


def _segments(docs, spans, gram):
    """Segments of all texts: gram, name, left (bytes before the sampled place), n windows, size in bytes, first byte, and the text's key.

    A segment holds its windows of the shortest span and whatever of the longest begins with one of them.
    """
    span, reach = min(spans), max(spans)
    texts = _texts(docs).filter(F.octet_length("text") >= span)

    def segments_of(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            rows = []
            for row in range(len(offsets) - 1):
                text = data[offsets[row]:offsets[row + 1]]
                whole = text.tobytes()
                for value, place, first, last in sample(text, span, gram):
                    body = whole[first:last + reach]
                    digest = hashlib.blake2b(body, digest_size=8, key=(place - first).to_bytes(4, "little") + (last - first).to_bytes(4, "little")).digest()
                    name = int.from_bytes(digest, "little", signed=True)
                    rows.append((int(value.astype(np.int64)), name, place - first, last - first + 1, len(body), first, k1[row], k2[row]))
                    if len(rows) > 1 << 16:
                        yield _batch(rows, _PLACE)
                        rows = []
            yield _batch(rows, _PLACE)
    return texts.mapInArrow(segments_of, _ddl(_PLACE))


_PLACE = {"gram": pa.int64(), "name": pa.int64(), "left": pa.int32(), "n": pa.int32(), "size": pa.int32(), "first": pa.int32(), "k1": pa.int64(), "k2": pa.int64()}
_BODY = {**{k: _PLACE[k] for k in ("gram", "name", "left", "n")}, "twice": pa.bool_(), "k1": pa.int64(), "k2": pa.int64(), "place": pa.int64(), "body": pa.binary()}
_PIECE = {"k1": pa.int64(), "k2": pa.int64(), "span": pa.int32(), "start": pa.int64(), "end": pa.int64()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(kinds):
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in kinds.items())


def _batch(rows, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds.values())], list(kinds))


def _bodies(docs, wanted):
    """The bytes of the wanted segments (gram, name, left, n, size, twice), each read from the one place k1, k2, first."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "name", "left", "n", "size", "twice", "first")).alias("places"))  # as many as the text has
    rows = _texts(docs).join(shared.stage(lists), ["k1", "k2"])

    def bodies_of(batches):
        before = None
        for batch in batches:
            out, held = [], 0
            for k1, k2, text, places in zip(*(batch.column(c) for c in ("k1", "k2", "text", "places"))):
                key = k1.as_py(), k2.as_py()
                if key == before:  # copies of a text lie side by side; what still comes twice is dropped by its name
                    continue
                before, text = key, text.as_py().encode()
                for p in places.as_py():
                    body = text[p["first"]:p["first"] + p["size"]]
                    out.append((p["gram"], p["name"], p["left"], p["n"], p["twice"], *key, p["first"] + p["left"], body))
                    held += len(body)
                if held > 1 << 23:
                    yield _batch(out, _BODY)
                    out, held = [], 0
            yield _batch(out, _BODY)
    return rows.mapInArrow(bodies_of, _ddl(_BODY))


def same_start(a, b):
    """Length of the common prefix of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


class Segment:
    """One segment: what follows the sampled place, what precedes it backwards, the offsets of its windows, and those found elsewhere by span."""

    __slots__ = ("ahead", "behind", "low", "high", "same")

    def __init__(self, body, left, n, spans):
        self.ahead, self.behind, self.low, self.high, self.same = body[left:], body[:left][::-1], left - n + 1, left, {span: [] for span in spans}

    def meet(self, other, ahead, behind):
        first, high = max(self.low, other.low), min(behind, self.high, other.high)
        for span, found in self.same.items():
            low = max(span - ahead, first)
            if low <= high:
                found.append((low, high))
                other.same[span].append((low, high))


def merge_neighbours(segments, backwards=False):
    """Give each of the segments, sorted by one side, the offsets at which another has the same window.

    Groups of neighbours are merged from the longest common side down. Members of the smaller group look up
    their place among the other sides of the larger; whoever is nearest there agrees furthest.
    """
    def sides(s):
        return (s.behind, s.ahead) if backwards else (s.ahead, s.behind)
    reach = [same_start(sides(a)[0], sides(b)[0]) for a, b in zip(segments, segments[1:])]
    group, members = list(range(len(segments))), {k: [(sides(s)[1], k)] for k, s in enumerate(segments)}

    def find(k):
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k
    for k in sorted(range(len(reach)), key=lambda k: -reach[k]):
        small, large = sorted((find(k), find(k + 1)), key=lambda g: len(members[g]))
        held = members[large]
        for side, own in members[small]:
            at = bisect_left(held, (side, own))
            for other_side, other in held[max(0, at - 1):at + 1]:
                common = same_start(side, other_side)
                segments[own].meet(segments[other], *((common, reach[k]) if backwards else (reach[k], common)))
        for entry in members.pop(small):
            insort(held, entry)
        group[small] = large


def _whole_grams(bodies, ranges, spans):
    """(k1, k2, span, start, end) of the bytes of matching windows, for grams that one task can hold."""
    rows = bodies.repartition(ranges, "gram").sortWithinPartitions("gram")

    def found(batches):
        fields = [f for f in _BODY if f != "gram"]
        rows = ((r["gram"], [r[f] for f in fields]) for batch in batches for r in batch.to_pylist())
        out = []
        for _, held in groupby(rows, lambda r: r[0]):
            unique = {row[0]: row for _, row in held}
            made = sorted(((Segment(row[-1], row[1], row[2], spans), row) for row in unique.values()), key=lambda x: x[0].ahead)
            merge_neighbours([segment for segment, _ in made])
            for segment, (_, _, _, twice, k1, k2, place, _) in made:
                if not twice:
                    out += [(k1, k2, span, place - high, place - low + span) for span, same in segment.same.items() for low, high in _union(same)]
            if len(out) > 1 << 16:
                yield _batch(out, _PIECE)
                out = []
        yield _batch(out, _PIECE)
    return rows.mapInArrow(found, _ddl(_PIECE))


def _union(offsets):
    """Sorted intervals, those that overlap or touch as one."""
    out = []
    for low, high in sorted(offsets):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _compared(bodies, span, ranges, backwards):
    """Segments sorted by one side in ranges: the offsets at which one of the range has the same window (`same`), and how far that side agrees with an end of the range (`open`).

    Rows beyond an end of a range agree no further than the row at that end does.
    """
    # Reversed half bytes sort differently from reversed bytes, but rows with longer common ends are still next to each other.
    sides = [F.expr("substring(body, left + 1)"), F.reverse(F.substring(F.hex("body"), F.lit(1), F.col("left") * 2))]
    rows = bodies.withColumn("side", sides[backwards]).withColumn("other", sides[not backwards])
    rows = rows.repartitionByRange(ranges, "gram", "side", "other").sortWithinPartitions("gram", "side", "other")

    def compared(batches):
        rows = ((r["gram"], r) for batch in batches for r in batch.to_pylist())
        grams = ((gram, [r for _, r in held]) for gram, held in groupby(rows, lambda r: r[0]))
        first, at = True, next(grams, None)
        while at is not None:
            following = next(grams, None)
            gram, held = at
            made = [Segment(r["body"], r["left"], r["n"], [span]) for r in held]
            merge_neighbours(made, backwards)
            ends = [made[0]] * first + [made[-1]] * (following is None)
            out = []
            for r, s in zip(held, made):
                reach = [same_start(s.behind, e.behind) if backwards else same_start(s.ahead, e.ahead) for e in ends]
                out.append((gram, r["name"], max(reach, default=0) if ends else -1, [{"low": low, "high": high} for low, high in _union(s.same[span])]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), same))], ["gram", "name", "open", "same"])
            first, at = False, following

    same = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    return rows.select("gram", "name", "left", "n", "body").mapInArrow(compared, "gram long, name long, open int, same array<struct<low: int, high: int>>")


def _remaining(rows, span):
    """(digest of window and offset, gram, name, offset) of the asked offsets that a segment can repeat at."""
    kinds = {"window": pa.binary(), "gram": pa.int64(), "name": pa.int64(), "offset": pa.int32(), "times": pa.int32()}

    def windows_of(batches):
        for batch in batches:
            out = []
            for gram, name, left, twice, body, offsets in zip(*(batch.column(c).to_pylist() for c in ("gram", "name", "left", "twice", "body", "offsets"))):
                for offset in offsets:
                    window = body[left - offset:left - offset + span]
                    digest = hashlib.blake2b(window, digest_size=16, key=offset.to_bytes(4, "little")).digest()
                    out.append((digest, gram, name, offset, 2 if twice else 1))
            yield _batch(out, kinds)
    return rows.select("gram", "name", "left", "twice", "body", "offsets").mapInArrow(windows_of, _ddl(kinds))


def _large_grams(bodies, span, ranges):
    """(k1, k2, span, start, end) of the bytes of matching windows of one span, for grams too large for one task."""
    ahead = _compared(bodies, span, ranges, False).select("gram", "name", F.col("open").alias("ahead"), F.col("same").alias("same1"))
    behind = _compared(bodies, span, ranges, True).select("gram", "name", F.col("open").alias("behind"), F.col("same").alias("same2"))
    known = bodies.drop("body").join(ahead, ["gram", "name"]).join(behind, ["gram", "name"])
    low = F.greatest(F.lit(span) - F.col("ahead"), F.col("left") - F.col("n") + 1)
    known = known.select("gram", "name", "twice", "k1", "k2", "place", low.alias("low"), F.least("behind", "left").alias("high"), F.concat("same1", "same2").alias("same"))
    possible = F.when(F.col("low") <= F.col("high"), F.sequence("low", "high")).otherwise(F.array().cast("array<int>"))
    undecided = F.when(F.col("twice"), F.array().cast("array<int>")).otherwise(F.filter(possible, lambda o: ~F.exists("same", lambda s: o.between(s.low, s.high))))
    known = shared.stage(known.withColumn("undecided", undecided))

    asked = shared.stage(known.select("gram", F.explode("undecided").alias("offset")).distinct().groupBy("gram").agg(F.collect_set("offset").alias("asked")))  # span offsets at most
    partners = known.select("gram", "name", "low", "high").join(asked, "gram").withColumn("offsets", F.filter("asked", lambda o: o.between(F.col("low"), F.col("high"))))
    partners = partners.filter(F.size("offsets") > 0).select("gram", "name", "offsets").join(bodies, ["gram", "name"])
    windows = shared.stage(_remaining(partners, span))
    twice = windows.groupBy("window").agg(F.sum("times").alias("n")).filter("n > 1").select("window")
    merged = windows.join(twice, "window").select("gram", "name", F.col("offset").alias("low"), F.col("offset").alias("high"))
    merged = merged.join(known.filter("not twice").select("gram", "name", "k1", "k2", "place"), ["gram", "name"]).select("k1", "k2", "place", "low", "high")
    matched = known.filter("not twice").select("k1", "k2", "place", F.explode("same").alias("s")).select("k1", "k2", "place", "s.low", "s.high")
    return matched.union(merged).select("k1", "k2", F.lit(span).alias("span"), (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + span).alias("end"))


def repeated(docs, spans=(SPAN,), gram=GRAM):
    """(k1, k2, runs of each span): the maximal runs (start, end) of bytes that repeated strings of that length cover, for texts that have any."""
    places = shared.stage(_segments(docs, spans, gram))
    named = shared.stage(places.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("c")))

    # Grams with a segment that occurs once only and another segment are compared byte by byte.
    most = min(spans) - gram + max(spans)  # bytes of the longest segment
    sizes = named.groupBy("gram").agg(F.min("c").alias("least"), (F.count(F.lit(1)) * most).alias("size")).filter(F.expr("least = 1") & (F.col("size") > most))
    sizes = shared.stage(sizes.select("gram", "size", (F.col("size") > RANGE_BYTES).alias("large")))
    total = {row["large"]: -(-row["n"] // RANGE_BYTES) for row in sizes.groupBy("large").agg(F.sum("size").alias("n")).collect()}
    named = named.join(sizes.select("gram", "large"), "gram", "left").filter("c > 1 or large is not null")
    places = shared.stage(places.join(named, ["gram", "name"]))

    found = F.array(*[F.struct(F.lit(span).alias("span"), F.least(F.col("n") - 1 + span, "size").alias("long")) for span in spans])
    full = places.filter("c > 1").select("k1", "k2", "first", F.explode(found).alias("s")).filter("s.long >= s.span")
    full = full.select("k1", "k2", "s.span", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("s.long")).cast("long").alias("end"))
    # One row gives all first values, so they are one place's.
    wanted = places.filter("large is not null").groupBy("gram", "name").agg(*[F.first(c).alias(c) for c in (*list(_PLACE)[2:], "c", "large")]).withColumn("twice", F.col("c") > 1)
    for large, ranges in sorted(total.items()):
        bodies = _bodies(docs, wanted.filter(F.col("large") == large))
        if not large:  # staged, so the shuffle of the texts is done with before segments and pieces are shuffled
            full = full.union(_whole_grams(shared.stage(bodies), ranges, spans))
            continue
        bodies = shared.stage(bodies.groupBy("gram", "name").agg(*[F.first(c).alias(c) for c in _BODY if c not in ("gram", "name")]))
        for span in spans:
            full = full.union(_large_grams(bodies, span, ranges))
    pieces = [F.sort_array(F.collect_set(F.when(F.col("span") == span, F.struct("start", "end")))).alias(f"runs{span}") for span in spans]
    return full.groupBy("k1", "k2").agg(*pieces).select("k1", "k2", *[_joined(f"runs{span}").alias(f"runs{span}") for span in spans])


def _joined(pieces):
    """Sorted pieces that overlap or touch as one run each."""
    run = "array<struct<start: bigint, end: bigint>>"
    start = F.struct(F.array().cast(run).alias("done"), F.lit(None).cast("struct<start: bigint, end: bigint>").alias("last"))

    def step(acc, piece):
        piece = F.struct(piece.start.cast("long").alias("start"), piece.end.cast("long").alias("end"))
        grown = F.struct(acc.last.start.alias("start"), F.greatest(acc.last.end, piece.end).alias("end"))
        return (F.when(acc.last.isNull(), F.struct(acc.done.alias("done"), piece.alias("last")))
                .when(piece.start <= acc.last.end, F.struct(acc.done.alias("done"), grown.alias("last")))
                .otherwise(F.struct(F.concat(acc.done, F.array(acc.last)).alias("done"), piece.alias("last"))))
    return F.aggregate(pieces, start, step, lambda acc: F.when(acc.last.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.last))))


def _with_runs(docs, spans, gram):
    """The rows with `__runs<span>` for each span: an array, empty or null where nothing of that length repeats."""
    runs = shared.stage(repeated(docs, spans, gram)).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), *[F.col(f"runs{span}").alias(f"__runs{span}") for span in spans])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__a", F.xxhash64(text)).withColumn("__b", F.xxhash64(F.lit("second"), text))
    return keyed.join(runs, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left").drop("__a", "__b", "__k1", "__k2")


def kept_bytes(text, runs):
    parts, at = [], 0
    for run in runs or ():
        parts.append(text[at:run["start"]])
        at = run["end"]
    parts.append(text[at:])
    return b"".join(parts)


def digests(docs, span=SPAN, gram=GRAM, passage=None):
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With a `passage` of at most `span` bytes also n_passage_bytes: bytes covered by strings of that length that start twice. They are counted, not removed.
    """
    rows = _with_runs(shared.documents(docs), sorted({span, passage or span}), gram)
    runs = F.col(f"__runs{span}")

    @F.arrow_udf("n_bytes long, kept long, sha string")
    def summed(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, cut in zip(texts.to_pylist(), runs.to_pylist()):
            kept = kept_bytes(text or b"", cut)
            out.append((len(text or b""), len(kept), hashlib.sha256(kept).hexdigest()))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()))], ["n_bytes", "kept", "sha"])
    rows = rows.withColumn("d", summed.asNondeterministic()(F.col("text").cast("binary"), runs))
    counted = [] if passage is None else [F.aggregate(F.coalesce(f"__runs{passage}", F.array()), F.lit(0).cast("long"), lambda n, run: n + run.end - run.start).alias("n_passage_bytes")]
    return rows.select("doc_id", F.col("d.n_bytes").alias("n_bytes"), (F.col("d.n_bytes") - F.col("d.kept")).alias("n_removed"),
                       F.coalesce(F.size(runs), F.lit(0)).cast("long").alias("n_spans"), F.col("d.sha").alias("kept_sha256"), *counted)


def cut(docs, span=SPAN, gram=GRAM):
    """The documents, all columns, with the repeated bytes taken out of `text`; a code point that loses some of its bytes goes as a whole. Null stays null."""
    @F.arrow_udf("string")
    def cut_text(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([None if text is None else text.decode("utf-8", "replace") if not run else kept_bytes(text, run).decode("utf-8", "ignore")
                         for text, run in zip(texts.to_pylist(), runs.to_pylist())], pa.string())
    rows = _with_runs(docs, [span], gram)
    runs = F.col(f"__runs{span}")
    text = F.when(runs.isNotNull(), cut_text.asNondeterministic()(F.col("text").cast("string").cast("binary"), runs)).otherwise(F.col("text").cast("string"))
    return rows.withColumn("text", text).select(*docs.columns)


def op4_suffix_dedup(spark, sf_dir):
    return digests(shared.table(spark, sf_dir, "documents"), passage=PASSAGE)


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES = {}
