"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

A token's input is two vectors: the embedding of its word, and the element-wise maximum of the embeddings
of its character 4-grams (with marks for start and end), so unseen forms of a known stem are
recognized. Both tables have a fixed number of hashed rows. Two gated recurrent layers read each window
from both sides, attention pools their states, a linear unit gives the logit. A text's score is
that of its highest window. Windows begin every `STEP` words and with the last words, so each phrase of up to
WINDOW - STEP + 1 = 21 words is whole in one of them; not every window of `WINDOW` words is read.

The network is trained here with numpy, on a bounded sample of labelled rows (`MAX_TOXIC`, `MAX_CLEAN`) of
any length: a text counts by its highest window (multiple-instance learning). The sampled texts are cut into
windows on the executors. A text of more than `TRAIN_WINDOWS` windows, or of more than `TRAIN_BYTES` bytes in
its words, gives the windows that come first by a seeded hash over the whole text, up to both numbers and
at least one. Every whole text is scored, in Arrow batches; the model is broadcast, and its size is fixed by
the numbers below.

Null, empty and wordless texts get the score of the share of toxic rows in training. Without training
rows of both kinds all scores are 0, with a warning where the labels drawn hold both kinds but no documents of one. Repeated rows score alike; in training
an id counts once, with its least label and text. Further columns are kept by `scored`, but
`score` and `predicted` of the input are replaced.
"""

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared
from groundwork.llm.words import Words, mix, raw, slices

WINDOW = 24
STEP = 4
#: Windows whose words are looked up at a time.
BLOCK = 1 << 17
HIDDEN = 8
EMBED = 8
BUCKETS = 1 << 15
MAX_TOXIC = 1_200
MAX_CLEAN = 3_000
TRAIN_WINDOWS = 128
TRAIN_BYTES = 1 << 15
EPOCHS = 6
BATCH = 128
RATE = 0.01
SEED = 11
#: Training texts a word or 4-gram must occur in to have a vector; all others are zero, in training and later.
MIN_DOCS = 4


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Distinct words of a slice: `of` each word; word buckets; buckets of their 4-grams, which begin at `starts`."""

    def __init__(self, words):
        hashes = words.hashes()
        _, first, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (hashes[first] >> np.uint64(64 - 15)).astype(np.int64)
        start, size = words.start[first], words.end[first] - words.start[first]
        self.starts = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(self.starts, size)
        target = np.repeat(self.starts + 3 * np.arange(len(size)), size) + inner  # word k begins three marks later for each word before it
        text = np.full(size.sum() + 3 * len(size) + 3, ord("$"), np.uint32)
        text[self.starts + 3 * np.arange(len(size))] = ord("^")
        text[target + 1] = words.low[np.repeat(start, size) + inner]
        code = text[target] | text[target + 1] << 8 | text[target + 2] << 16 | text[target + 3] << 24
        self.gram = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


class Joined:
    """Words of many texts, taken slice by slice; of each slice the distinct words are kept (`low`, `start`, `end`), and which of them each word is (`of`)."""

    def __init__(self, texts):
        offsets = np.cumsum([0, *map(len, texts)])
        parts, begun, distinct, seen = [], 0, 0, 0
        for a, b in slices(offsets):
            words = Words(np.frombuffer(b"".join(texts[a:b]), np.uint8), offsets[a:b + 1] - offsets[a])
            hashes, at, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
            start, size = words.start[at], words.end[at] - words.start[at]
            end = np.cumsum(size)
            low = words.low[np.repeat(start - (end - size), size) + np.arange(size.sum())]
            parts.append((low, end - size + begun, end + begun, words.first[:-1] + seen, hashes, (of + distinct).astype(np.int32)))
            begun, distinct, seen = begun + len(low), distinct + len(hashes), seen + len(words.start)
        kinds = (np.uint8, np.int64, np.int64, np.int64, np.uint64, np.int32)
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]
        self.low, self.start, self.end, self.first, self._hashes, self.of = columns
        self.first = np.append(self.first, seen)

    def hashes(self):
        return self._hashes


def spans(words):
    """(begin, row): number of each window's first word among those of all rows, and the row it is of."""
    counts = np.diff(words.first)
    many = np.where(counts <= WINDOW, (counts > 0).astype(np.int64), -(-(counts - WINDOW) // STEP) + 1)
    row = np.repeat(np.arange(len(counts)), many)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return words.first[:-1][row] + np.minimum(number * STEP, np.maximum(counts[row] - WINDOW, 0)), row  # the last window ends with the text


def places_of(words, begin, row):
    """Word numbers of each window (-1: none)."""
    places = begin[:, None] + np.arange(WINDOW)[None, :]
    return np.where(places < words.first[1:][row][:, None], places, -1)


def windows(words):
    """(places, row): word numbers of each window (-1: none), and the row it is of; every word is in a window."""
    begin, row = spans(words)
    return places_of(words, begin, row), row


def new_model(rng):
    inputs = 2 * EMBED
    model = {"word": rng.normal(0, 0.05, (BUCKETS, EMBED)), "gram": rng.normal(0, 0.05, (BUCKETS, EMBED))}
    for side in ("f", "b"):
        model[f"w{side}"] = rng.normal(0, inputs ** -0.5, (inputs, 3 * HIDDEN))
        model[f"u{side}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))
        model[f"c{side}"] = np.zeros(3 * HIDDEN)
    model |= {"attend": rng.normal(0, 0.5, 2 * HIDDEN), "out": rng.normal(0, 0.5, 2 * HIDDEN), "bias": np.zeros(1), "empty": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def inputs_of(model, vocabulary):
    """Input vectors of the distinct words, a last row of zeros for no word, and the 4-grams' vectors."""
    grams = model["gram"][vocabulary.gram]
    highest = np.maximum.reduceat(grams, vocabulary.starts) if len(grams) else np.zeros((0, EMBED), np.float32)
    x = np.concatenate([model["word"][vocabulary.word], highest], axis=1)
    return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), grams


def all_inputs(model, vocabulary, block=1 << 15):
    """The same without the 4-grams' vectors, in blocks of words."""
    rows = [inputs_of(model, _Part(vocabulary, np.arange(k, min(k + block, len(vocabulary.word)))))[0][:-1] for k in range(0, len(vocabulary.word), block)]
    return np.concatenate([*rows, np.zeros((1, 2 * EMBED), np.float32)])


def _run(projected, u, ids, mask, keep):
    """States of one direction, steps x windows x HIDDEN; with `keep` what the way back needs."""
    n, h = ids.shape[0], HIDDEN
    state, states, kept = np.zeros((n, h), np.float32), np.empty((ids.shape[1], n, h), np.float32), []
    for t in range(ids.shape[1]):
        x, s = projected[ids[:, t]], state @ u
        gates = sigmoid(x[:, :2 * h] + s[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h:] + r * s[:, 2 * h:])
        after = new + z * (state - new)
        if not mask[:, t].all():
            after = np.where(mask[:, t][:, None], after, state)
        if keep:
            kept.append((state, z, r, new, s[:, 2 * h:]))
        state = states[t] = after
    return states, kept


def forward(model, x, ids, mask, keep=False):
    """Logits of windows; ids are rows of x."""
    ahead, kept_f = _run(x @ model["wf"] + model["cf"], model["uf"], ids, mask, keep)
    back, kept_b = _run(x @ model["wb"] + model["cb"], model["ub"], ids[:, ::-1], mask[:, ::-1], keep)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    weight = np.where(mask.T, states @ model["attend"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ model["out"] + model["bias"][0], (states, weight, pooled, kept_f, kept_b)


def gradients(model, vocabulary, x, grams, ids, mask, target):
    """Gradients of the mean log loss of windows."""
    logit, (states, weight, pooled, kept_f, kept_b) = forward(model, x, ids, mask, keep=True)
    d = ((sigmoid(logit) - target) / len(target)).astype(np.float32)
    grad = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * model["out"]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["attend"] = np.einsum("tn,tnh->h", d_energy, states)
    d_states = weight[:, :, None] * d_pooled + d_energy[:, :, None] * model["attend"]
    dx = np.zeros_like(x)
    for side, kept, order, d_out in (("f", kept_f, ids, d_states[:, :, :HIDDEN]), ("b", kept_b, ids[:, ::-1], d_states[::-1, :, HIDDEN:])):
        seen = mask if side == "f" else mask[:, ::-1]
        u, du, d_in = model[f"u{side}"], np.zeros_like(model[f"u{side}"]), np.zeros((len(x), 3 * HIDDEN), np.float32)
        back = np.zeros((len(target), HIDDEN), np.float32)
        for t in reversed(range(ids.shape[1])):
            state, z, r, new, inner = kept[t]
            whole = back + d_out[t]
            live = seen[:, t][:, None]
            dh = np.where(live, whole, 0)
            dz, dn = dh * (state - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
            dr, dm = dn * inner * r * (1 - r), dn * r
            np.add.at(d_in, order[:, t], np.concatenate([dz, dr, dn], axis=1))
            ds = np.concatenate([dz, dr, dm], axis=1)
            du += state.T @ ds
            back = np.where(live, dh * z + ds @ u.T, whole)
        grad[f"u{side}"], grad[f"w{side}"], grad[f"c{side}"] = du, x.T @ d_in, d_in.sum(axis=0)
        dx += d_in @ model[f"w{side}"].T
    d_gram = np.zeros_like(grams)
    size = np.diff(np.append(vocabulary.starts, len(grams)))
    owner = np.repeat(np.arange(len(size)), size)
    d_gram = np.where(grams == x[owner, EMBED:], dx[owner, EMBED:], 0)
    return grad, dx[:-1, :EMBED], d_gram


def _log_odds(vocabulary, first, toxic):
    """For words and 4-grams by bucket: log odds of a toxic text (a quarter), and whether enough texts have it."""
    counts = {name: np.zeros((2, BUCKETS)) for name in ("word", "gram")}
    for kind, a, b in zip(toxic, first[:-1], first[1:]):
        part = _Part(vocabulary, np.unique(vocabulary.of[a:b]))
        counts["word"][kind][np.unique(part.word)] += 1
        counts["gram"][kind][np.unique(part.gram)] += 1
    out = {}
    for name, (no, yes) in counts.items():
        odds = np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / ((1 - toxic).sum() + 1))
        out[name] = (odds / 4).astype(np.float32), yes + no >= MIN_DOCS
    return out


class _Part:
    """Some words of a vocabulary as a vocabulary of their own."""

    def __init__(self, vocabulary, ids):
        size = np.diff(np.append(vocabulary.starts, len(vocabulary.gram)))[ids]
        self.word, self.starts = vocabulary.word[ids], np.cumsum(size) - size
        self.gram = vocabulary.gram[np.repeat(vocabulary.starts[ids], size) + np.arange(size.sum()) - np.repeat(self.starts, size)]


def train(texts, toxic):
    """The model for texts and their labels; None without labels of both kinds. A text is bytes, or a list of some of its windows."""
    toxic = np.asarray(toxic, np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return None
    rng = np.random.default_rng(SEED)
    model = new_model(rng)
    model["empty"][0] = toxic.mean()
    pieces = [[text] if isinstance(text, bytes) else text for text in texts]
    begin = np.cumsum([0, *map(len, pieces)])
    words = Joined([piece for text in pieces for piece in text])
    if not len(words.start):
        return model
    vocabulary = Vocabulary(words)
    vocabulary.of = vocabulary.of.astype(np.int32)[words.of]
    known = {}
    for name, (odds, often) in _log_odds(vocabulary, words.first[begin], toxic).items():
        model[name][:, 0], known[name] = odds, often
        model[name][~often] = 0

    places, row = windows(words)
    row = np.repeat(np.arange(len(pieces)), np.diff(begin))[row]
    mask = places >= 0
    ids = np.where(mask, vocabulary.of[places], np.int32(len(vocabulary.word)))
    del places
    x = all_inputs(model, vocabulary)
    logit = (x[:, 0] + x[:, EMBED])[ids].max(axis=1)  # the first choice of windows
    second = {k: np.zeros_like(v) for k, v in model.items()}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            logit = logits(model, all_inputs(model, vocabulary), ids, mask)
        best = _highest(logit, row)
        extra = rng.choice(np.flatnonzero(toxic[row] == 0), size=min(len(best), 2 * len(texts)))  # any window of a clean text is clean
        chosen = rng.permutation(np.concatenate([best, extra]))
        for low in range(0, len(chosen), BATCH):
            part = chosen[low:low + BATCH]
            live, local = np.unique(ids[part], return_inverse=True)
            local, live = local.reshape(len(part), WINDOW), live[live < len(vocabulary.word)]
            local = np.where(mask[part], local, len(live))
            sub = _Part(vocabulary, live)
            x, grams = inputs_of(model, sub)
            grad, d_word, d_gram = gradients(model, sub, x, grams, local, mask[part], toxic[row[part]])
            step += 1
            for name, g in grad.items():  # Adam
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                model[name] -= RATE * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-7)
            for name, at, g in (("word", sub.word, d_word), ("gram", sub.gram, d_gram)):  # Adagrad on the rows in use
                total = np.zeros_like(model[name])
                np.add.at(total, at, g)
                used = np.unique(at)
                used = used[known[name][used]]
                second[name][used] += total[used] ** 2
                model[name][used] -= 0.02 * total[used] / (np.sqrt(second[name][used]) + 1e-5)
    # The cut that parts the training texts best becomes logit 0; in its gap it lies nearer to the toxic texts.
    logit = logits(model, all_inputs(model, vocabulary), ids, mask)
    best = _highest(logit, row)
    value, label = logit[best], toxic[row[best]]
    order = np.argsort(value)
    value, label = value[order], label[order]
    right = np.concatenate([[0], np.cumsum(1 - label)]) + label.sum() - np.concatenate([[0], np.cumsum(label)])
    cut = int(np.median(np.flatnonzero(right == right.max())))
    if 0 < cut < len(value):
        model["bias"] -= 0.4 * value[cut - 1] + 0.6 * value[cut]
    return model


def _highest(logit, row):
    order = np.lexsort((logit, row))
    return order[np.append(np.flatnonzero(row[order][1:] != row[order][:-1]), len(order) - 1)]


def logits(model, x, ids, mask, block=8192):
    """Logits of windows without the way back: of each state only its attention and its part of the output are kept."""
    h, parts = HIDDEN, []
    half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)  # sigmoid(x) = 0.5 + 0.5 tanh(x / 2)
    sides = [(np.ascontiguousarray(((x @ model[f"w{side}"] + model[f"c{side}"]) * half).T), np.ascontiguousarray((model[f"u{side}"] * half).T),
              np.stack([model[name][k * h:(k + 1) * h] for name in ("attend", "out")])) for k, side in enumerate("fb")]
    for low in range(0, len(ids), block):
        at, live = np.ascontiguousarray(ids[low:low + block].T), np.ascontiguousarray(mask[low:low + block].T)
        whole, n = live.all(axis=1), at.shape[1]
        read = np.zeros((len(at), 2, n), np.float32)
        for k, (projected, u, heads) in enumerate(sides):
            state = np.zeros((h, n), np.float32)
            for t in range(len(at)) if k == 0 else reversed(range(len(at))):
                gates, inner = projected.take(at[t], axis=1), u @ state
                gates[:2 * h] += inner[:2 * h]
                np.tanh(gates[:2 * h], out=gates[:2 * h])
                gates[:2 * h] *= 0.5
                gates[:2 * h] += 0.5
                inner[2 * h:] *= gates[h:2 * h]
                gates[2 * h:] += inner[2 * h:]
                new = np.tanh(gates[2 * h:], out=gates[2 * h:])
                after = state - new
                after *= gates[:h]
                after += new
                state = after if whole[t] else np.where(live[t], after, state)
                read[t] += heads @ state
        weight = np.where(live, read[:, 0], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        parts.append((weight * read[:, 1]).sum(axis=0) / weight.sum(axis=0) + model["bias"][0])
    return np.concatenate(parts)


def scores(model, data, offsets):
    """Score of each row of a slice."""
    words = Words(data, offsets)
    out = np.full(len(words.first) - 1, model["empty"][0], np.float64)
    if len(words.start):
        vocabulary = Vocabulary(words)
        begins, row = spans(words)
        x, parts = all_inputs(model, vocabulary), []
        for low in range(0, len(begins), BLOCK):
            places = places_of(words, begins[low:low + BLOCK], row[low:low + BLOCK])
            mask = places >= 0
            parts.append(logits(model, x, np.where(mask, vocabulary.of[places], len(vocabulary.word)), mask))
        logit = np.concatenate(parts)
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[begin]] = sigmoid(np.maximum.reduceat(logit, begin).astype(np.float64))
    return out


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def excerpts(data, offsets):
    """For each row of a slice a list: its words joined, or, where they are too many, windows by a seeded hash over all of its windows."""
    words = Words(data, offsets)
    begins, row = spans(words)
    at, hashes = np.searchsorted(row, np.arange(len(words.first))), words.hashes()
    out = []
    for k, (first, last) in enumerate(zip(words.first[:-1], words.first[1:])):
        mine = begins[at[k]:at[k + 1]]
        if len(mine) <= TRAIN_WINDOWS and (words.end[first:last] - words.start[first:last]).sum() <= TRAIN_BYTES:
            out.append([words.text(first, last)])
            continue
        seed = hashes[first:last].sum(keepdims=True) + np.uint64(SEED)
        taken, room = [], TRAIN_BYTES
        for begin in mine[np.argsort(mix(seed + np.arange(len(mine), dtype=np.uint64)), kind="stable")[:TRAIN_WINDOWS]]:
            window = words.text(begin, min(begin + WINDOW, last))
            room -= len(window)
            if taken and room < 0:
                break
            taken.append(window)
        out.append(taken)
    return out


def training_rows(docs, labels):
    """Texts (see `train`) and labels of the bounded sample, those first by a hash of their id; never of held-out rows."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    parts = [labels.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    drawn = parts[0].union(parts[1])

    @F.arrow_udf("array<binary>")
    def excerpts_of(texts: pa.Array) -> pa.Array:
        data, offsets = raw(texts)
        rows = [row for a, b in slices(offsets) for row in excerpts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])]
        return pa.array(rows, pa.list_(pa.binary()))
    rows = shared.documents(docs).join(F.broadcast(drawn), "doc_id").filter("text is not null")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # map-side first: a row an id leaves a task
    rows = rows.select("doc_id", excerpts_of.asNondeterministic()(F.col("text").cast("binary")).alias("windows"), "toxic")
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    toxic = rows["toxic"].to_pylist()
    if len(set(toxic)) < 2 and drawn.select("toxic").distinct().count() == 2:
        warnings.warn(f"labels of both kinds were drawn, but only {len(toxic)} documents of one kind are there to train on: all scores are 0", stacklevel=2)
    return [windows[0] if len(windows) == 1 else windows for windows in rows["windows"].to_pylist()], toxic


def scored(docs, model):
    """The documents with score and predicted."""
    shape = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        if shape.value is None:
            return pa.array(np.zeros(len(texts)))
        data, offsets = raw(texts)
        parts = [scores(shape.value, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    rows = docs.withColumn("__score", score_of.asNondeterministic()(F.col("text").cast("string").cast("binary")))
    return shared.with_columns(rows, {"score": F.col("__score"), "predicted": (F.col("__score") >= 0.5).cast("int")}).drop("__score")


def op6_toxicity(spark, sf_dir):
    docs = shared.documents(shared.table(spark, sf_dir, "documents"))
    model = train(*training_rows(docs, shared.table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES = {}
