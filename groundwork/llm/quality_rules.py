"""Quality rules: a decision list of threshold conjunctions, learned from labelled statistics.

Statistics of every whole text are taken in Arrow batches; words are runs without ASCII white
space. From the labelled rows sequential covering learns rules for the rejected class: a rule
grows by the condition with most information gain on two thirds of the rows and is pruned from
its end on the other third; it stays if it is precise enough on both and in total, and the rows
it covers are taken out before the next. The list becomes one ordered Spark CASE expression.

The rules are fitted on a bounded sample: the `MAX_TRAIN` labelled rows that come first by a hash
of their id. All other numbers are of the row itself, so nothing depends on the size of the input.

Null and empty texts have no words, fail the base rules and are not kept. Labels without quality
or without a document teach nothing; without labels of both kinds no rule is learned. Repeated
rows are judged alike; in training an id counts once, with its least label and counts. Columns named like a result replace those of the input.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared

MAX_TRAIN = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Least share of truly bad rows among those that a rule covers, and least number of rows it covers in training.
MIN_PRECISION = 0.97
MIN_COVER = 8
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of a rule as Spark expressions over the counts.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}
_FOLLOWERS = bytes(range(128, 192))
_UPPER = bytes(range(65, 91))
_MARKS = b"!?.,;:\"'()[]{}-_/\\=+~^`@"


def counts(text):
    """COUNTS of one text given as UTF-8 bytes."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.translate(None, _FOLLOWERS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (len(words), chars, len(joined) - len(joined.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines),
            len(joined) - len(joined.translate(None, _UPPER)), len(joined) - len(joined.translate(None, _MARKS)))


def repeated(words, size=3):
    """Words inside windows of `size` words that stand at two places or more."""
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, reach = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            total += at + size - max(at, reach)
            reach = at + size
    return total


def counted(docs):
    """The documents with the struct `__counts`."""
    @F.arrow_udf(", ".join(f"{name} long" for name in COUNTS))
    def counts_of(texts: pa.Array) -> pa.Array:
        rows = [counts(text or b"") for text in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(COUNTS))], list(COUNTS))
    return docs.withColumn("__counts", counts_of.asNondeterministic()(F.col("text").cast("string").cast("binary")))


def _feature(name):
    expression = FEATURES[name]
    for count in COUNTS:
        expression = expression.replace(count, f"__counts.{count}")
    return F.expr(expression).cast("double")


def training_rows(docs, labels, max_rows=MAX_TRAIN):
    """Features and quality of the sampled labelled rows, on the driver; bounded by `max_rows`."""
    labels = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    sample = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = counted(shared.documents(docs).join(F.broadcast(sample), "doc_id"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("__counts").alias("__counts"))  # map-side first; at most max_rows short rows
    rows = rows.select("quality", *[_feature(name).alias(name) for name in FEATURES]).toPandas()
    return rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy() == 0


def learn(x, bad, names=tuple(FEATURES)):
    """Rules as tuples of (feature, "<=" or ">", threshold), in order."""
    order = np.lexsort((*x.T, bad)) if len(bad) else np.zeros(0, int)
    x, bad = x[order], bad[order]
    prune = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES and (left & bad).any():
        rule = _grown(x, bad, left & ~prune)
        rule = _pruned(rule, x, bad, left & prune)
        hit = covers(rule, x) & left
        if not rule or hit.sum() < MIN_COVER or any((hit & part & bad).sum() < MIN_PRECISION * (hit & part).sum() for part in (prune, ~prune)):
            break
        rules.append(tuple((names[f], sign, float(cut)) for f, sign, cut in rule))
        left &= ~hit
    return rules


def covers(rule, x):
    hit = np.ones(len(x), bool)
    for f, sign, cut in rule:
        hit &= x[:, f] <= cut if sign == "<=" else x[:, f] > cut
    return hit


def _grown(x, bad, inside):
    rule = []
    while len(rule) < MAX_CONDITIONS:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        best = (0.0, None)
        for f in range(x.shape[1]):
            values = np.unique(x[inside, f])
            middle = (values[1:] + values[:-1]) / 2
            if len(middle) > CUTS:
                middle = np.unique(np.quantile(x[inside & bad, f], np.linspace(0, 1, CUTS)))
            # rows at or below each cut, by class
            good_le, bad_le = (np.searchsorted(np.sort(x[inside & part, f]), middle, side="right") for part in (~bad, bad))
            for sign, pp, nn in (("<=", bad_le, good_le), (">", p - bad_le, n - good_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), 0.0)
                if len(gain) and gain.max() > best[0] + 1e-12:
                    best = (gain.max(), (f, sign, middle[gain.argmax()]))
        if best[1] is None:
            break
        f, sign, cut = best[1]
        values = x[inside, f]
        # Put the threshold in the middle of the gap between the rows it parts.
        below, above = values[values <= cut], values[values > cut]
        cut = float(below.max() + above.min()) / 2 if len(below) and len(above) else float(cut)
        rule = [c for c in rule if c[:2] != (f, sign)] + [(f, sign, cut)]
        inside = inside & covers(rule[-1:], x)
    return rule


def _pruned(rule, x, bad, inside):
    def worth(conditions):
        hit = covers(conditions, x) & inside
        return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def verdict(rules):
    """Number of the first rule that fits, from 1, as an ordered conditional expression; 0 if none does."""
    column = None
    for number, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for name, sign, cut in rule:
            value = _feature(name)
            fits = fits & (value <= F.lit(cut) if sign == "<=" else value > F.lit(cut))
        column = F.when(fits, number) if column is None else column.when(fits, number)
    return F.lit(0) if column is None else column.otherwise(0)


def judge(docs, rules):
    """The documents with counts, base_failed, `rule` (the learned rule that rejects) and kept."""
    rows = counted(docs)
    count = {name: F.col(f"__counts.{name}") for name in RESULTS}
    failed = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])
    return shared.with_columns(rows, count | {"base_failed": failed, "rule": verdict(rules).cast("int"), "kept": ~failed & (verdict(rules) == 0)}).drop("__counts")


def kept(docs, rules):
    """The documents, all columns as they are, that neither the base rules nor a learned rule reject."""
    rows = counted(docs)
    words, repeats = F.col("__counts.n_words"), F.col("__counts.n_repeat_words")
    stays = (words >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * words) & (verdict(rules) == 0)
    return rows.filter(stays).drop("__counts")


def op1_quality_rules(spark, sf_dir):
    docs = shared.documents(shared.table(spark, sf_dir, "documents"))
    rules = learn(*training_rows(docs, shared.table(spark, sf_dir, "labels")))
    return judge(docs, rules).select("doc_id", *RESULTS, "base_failed", "kept", "rule")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {}
