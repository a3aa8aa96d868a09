"""Mixing sources to target weights: budgets down a domain-language-source tree, then a token prefix of each leaf.

1. Tokens are summed per leaf; a node can take its children's tokens times `max_epochs`.
2. From the root down, a node's budget is shared among its children by weight, but no child gets
   more than it can take; what one cannot take goes to its siblings by their weights. Since a
   node's limit is the sum of its children's, a shortage leaves a node only when all inside it are full.
3. A leaf takes whole epochs while its budget lasts; of the last epoch it takes the documents
   first in that epoch's seeded order, as long as their running sum stays within what is left.

No task sorts a leaf: tokens are summed by the first three digits of the order key, and only the
one of 4,096 such buckets in which the budget ends is put in order, so a leaf with a third of
all rows costs no more than others. Texts are read once and never shuffled.

Null domain, language or source count as ''. Null and empty texts have no tokens. Rows alike in
id and token count share one place and are all taken or all left. A weight of 0 takes nothing;
a node without a weight of its own has that of its name at its level (`*/name`), else 1. No rows: no result.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwork.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
#: Domains of the sources; other sources are of domain "other".
DOMAINS = {"crawl": ("src0",), "reference": ("src1", "src2", "src3", "src4", "src5"), "forum": ("src6", "src7", "src8", "src9")}
#: Weights by path, or by name at any place of its level.
WEIGHTS = {"crawl": 3.0, "reference": 4.0, "forum": 1.0, "other": 2.0, "*/en": 4.0, "*/de": 2.0, "*/fr": 2.0, "*/es": 1.0,
           "reference/en/src1": 2.0}
#: Tokens to choose as a share of the tokens there are.
SHARE = 0.75
MAX_EPOCHS = 2
SEED = 17
LEVELS = ("domain", "lang", "source")


def leaf_columns(docs, domains):
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    named = [F.when(source.isin(*names), F.lit(domain)) for domain, names in domains.items()]
    return {"domain": F.coalesce(*named, F.lit("other")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def _weight(level, weights):
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    if known is None:
        return F.lit(1.0)
    path = F.concat_ws("/", *LEVELS[:level + 1])
    named = F.concat(F.lit("*/"), F.col(LEVELS[level]))
    return F.coalesce(F.try_element_at(known, path), F.try_element_at(known, named), F.lit(1.0))


def _shared_out(children, parents, budget):
    """Children with `given`: the parent's budget by weight, none above its `room`, the rest by weight among the others.

    With children in order of room / weight, the common level per unit of weight is the largest of
    (budget - room of those before) / (weight from here on).
    """
    children = children.withColumn("w", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).withColumn(
        "r", F.when(F.col("weight") > 0, F.col("room")).otherwise(0))
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    by_ratio = siblings.orderBy(F.try_divide("r", "w"), *[F.col(c) for c in LEVELS if c in children.columns])
    before = F.coalesce(F.sum("r").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(F.col("w") > 0, (budget - before) / onward)
    return children.withColumn("level", level).withColumn("level", F.max("level").over(siblings)).withColumn(
        "given", F.when(F.col("w") > 0, F.least(F.col("r").cast("double"), F.col("level") * F.col("w"))).otherwise(0.0)).drop("level", "w", "r", "weight")


def budgets(leaves, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS):
    """Leaves (domain, lang, source, tokens) with their `budget` in whole tokens."""
    tree = [None, None, leaves.withColumn("room", F.col("tokens") * max_epochs).withColumn("weight", _weight(2, weights))]
    for level in (1, 0):
        below = tree[level + 1]
        inside = F.sum(F.when(F.col("weight") > 0, F.col("room")).otherwise(0))
        tree[level] = below.groupBy(*LEVELS[:level + 1]).agg(inside.alias("room"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(level, weights))
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(share)).cast("double")
    given = _shared_out(tree[0], (), total).select("domain", F.col("given").alias("above"))
    for level in (1, 2):
        parents = LEVELS[:level]
        given = _shared_out(tree[level].join(given, list(parents)), parents, F.col("above"))
        given = given.drop("above").withColumnRenamed("given", "above") if level == 2 else given.select(*LEVELS[:level + 1], F.col("given").alias("above"))
    return given.select(*LEVELS, "tokens", F.floor(F.col("above") + 1e-6).cast("long").alias("budget"))


def order_key(seed, epoch):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(rows, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED):
    """Per leaf: budget, whole epochs, and where the last epoch's prefix ends (`bucket`, then `cut` in it)."""
    leaves = budgets(shared.stage(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))), weights, share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    leaves = shared.stage(leaves.withColumn("epochs", epochs).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")))
    open_leaves = leaves.filter("left > 0").select(*LEVELS, "epochs", "left")
    keyed = rows.join(open_leaves, list(LEVELS)).withColumn("key", order_key(seed, F.col("epochs"))).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "left", "bucket").agg(F.sum("n_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = sums.withColumn("upto", running).filter("upto > left").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", F.expr("upto - n").alias("base")), "bucket").alias("end"))
    ends = shared.stage(ends.select(*LEVELS, "end.bucket", "end.base"))
    inside = keyed.join(ends, [*LEVELS, "bucket"])
    place = F.struct("key", "doc_id", "n_tokens")
    upto = F.col("base") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy(place))  # rows alike share one sum
    cuts = inside.withColumn("upto", upto).filter("upto <= left").groupBy(*LEVELS).agg(F.max(place).alias("cut"))
    return leaves.join(ends.drop("base"), list(LEVELS), "left").join(cuts, list(LEVELS), "left")


def mix(docs, domains=DOMAINS, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED):
    """A row per chosen document and epoch: doc_id, domain, lang, source, n_tokens, epoch."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in leaf_columns(docs, domains).items()], words.alias("n_tokens"))
    rows = shared.stage(rows)
    chosen = rows.join(shared.stage(plan(rows, weights, share, max_epochs, seed)), list(LEVELS))
    key = order_key(seed, F.col("epochs"))
    prefix = F.substring(key, 1, 3)
    in_prefix = (F.col("left") > 0) & ((prefix < F.col("bucket")) | ((prefix == F.col("bucket")) & (F.struct(key.alias("key"), "doc_id", "n_tokens") <= F.col("cut"))))
    last = F.col("epochs") - 1 + F.coalesce(in_prefix, F.lit(False)).cast("int")
    return chosen.withColumn("last", last).filter("last >= 0").select(
        "doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("epoch"))


def op8_mixing(spark, sf_dir):
    return mix(shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


QUERIES = {"op8_mixing": op8_mixing}


def _sql_case():
    cases = " ".join(f"WHEN source IN ({', '.join(repr(n) for n in names)}) THEN '{domain}'" for domain, names in DOMAINS.items())
    return f"CASE {cases} ELSE 'other' END"


def _sql_level(name, rows, parents):
    """Common table expressions that share `above` out among the rows of a level."""
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = "ORDER BY r / w, " + ", ".join(LEVELS[:len(parents) + 1])
    return f"""
{name}_w AS (SELECT *, CASE WHEN weight > 0 THEN weight ELSE 0 END AS w, CASE WHEN weight > 0 THEN room ELSE 0 END AS r FROM {rows}),
{name}_l AS (SELECT *, CASE WHEN w > 0 THEN (above - coalesce(sum(r) OVER ({over} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER ({over} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS level FROM {name}_w),
{name} AS (SELECT * EXCLUDE (above, w, r, level), CASE WHEN w > 0 THEN least(r::DOUBLE, max(level) OVER ({over}) * w) ELSE 0 END AS given FROM {name}_l)"""


def _sql_weight(level):
    path = " || '/' || ".join(LEVELS[:level + 1])
    known = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())
    return (f"coalesce((SELECT v::DOUBLE FROM (VALUES {known}) AS k(n, v) WHERE n = {path}), "
            f"(SELECT v::DOUBLE FROM (VALUES {known}) AS k(n, v) WHERE n = '*/' || {LEVELS[level]}), 1.0::DOUBLE)")


ORACLES = {"op8_mixing": f"""
WITH d AS (
  SELECT doc_id, {_sql_case()} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
leaf AS (SELECT *, tokens * {MAX_EPOCHS} AS room, {_sql_weight(2)} AS weight FROM leaf0),
lang0 AS (SELECT domain, lang, sum(CASE WHEN weight > 0 THEN room ELSE 0 END)::BIGINT AS room FROM leaf GROUP BY ALL),
langs AS (SELECT *, {_sql_weight(1)} AS weight FROM lang0),
dom0 AS (SELECT domain, sum(CASE WHEN weight > 0 THEN room ELSE 0 END)::BIGINT AS room FROM langs GROUP BY ALL),
doms AS (SELECT *, {_sql_weight(0)} AS weight, floor((SELECT sum(tokens) FROM leaf0) * {SHARE})::DOUBLE AS above FROM dom0),
{_sql_level('top', 'doms', ())},
mid0 AS (SELECT l.*, t.given AS above FROM langs l JOIN top t USING (domain)),
{_sql_level('mid', 'mid0', ('domain',))},
low0 AS (SELECT l.*, m.given AS above FROM leaf l JOIN mid m USING (domain, lang)),
{_sql_level('low', 'low0', ('domain', 'lang'))},
b AS (SELECT domain, lang, source, tokens, floor(given + 1e-6)::BIGINT AS budget FROM low),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b),
k AS (SELECT d.*, epochs, budget - epochs * tokens AS rest, md5(concat_ws(':', '{SEED}', epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS key
      FROM d JOIN e USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens) AS upto FROM k),
l AS (SELECT *, epochs - 1 + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS last FROM s)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, last::BIGINT + 1))::BIGINT AS epoch FROM l WHERE last >= 0
"""}
