"""The corpus pipeline: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of their input. Stages take
tables without rows, null and empty texts and repeated rows as their operators state.
"""

from pyspark.sql import functions as F

from groundwork.llm import decontaminate, jaccard_join, mixing, quality_rules, shared, suffix_dedup

#: Bytes of a repeated string that the third stage cuts out: fifty words of four letters and a space.
PASSAGE = 250


def quality(spark, docs, sf_dir):
    """Documents that the base rules or a learned rule reject go."""
    rules = quality_rules.learn(*quality_rules.training_rows(docs, shared.table(spark, sf_dir, "labels")))
    return quality_rules.kept(docs, rules)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked at a Jaccard likeness of 0.8 or more the first stays."""
    return jaccard_join.first_of_groups(docs)


def repeated_strings(spark, docs, sf_dir):
    """Strings of `PASSAGE` bytes or more that stand twice are cut out of the texts; n_chars follows."""
    cut = suffix_dedup.cut(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def benchmark_passages(spark, docs, sf_dir):
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def target_weights(spark, docs, sf_dir):
    """The documents, and how often each, that fill the budgets of domains, languages and sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", target_weights),
]

#: The learned rules, the groups and the cuts cannot be stated in SQL. The operators have brute-force tests of their own; the chain is compared with its stages only.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents; each is written in the shared folder before the next begins."""
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.stage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
