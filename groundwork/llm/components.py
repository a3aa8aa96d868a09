"""Connected components of a graph given as a table of edges, by least labels and pointer jumps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwork.llm import shared


def components(edges):
    """(node, label) for the nodes of edges (a, b): the label is the component's least node.

    Each round takes the least label of a node's neighbours and then the label of that label, so
    long chains shrink quickly. A round is written to the shared folder before the next begins.
    """
    edges = _hooked(edges)
    links = shared.stage(edges.union(edges.select("b", "a")).distinct())
    labels = shared.stage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = shared.stage(lower.join(far, "label").select("node", "old", F.least("label", "far").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.filter("label != old").limit(1).count():
            return labels


def _hooked(edges):
    """The same components with fewer edges: each node keeps its least neighbour, which takes over its other edges.

    The many members of a dense group share few such neighbours, so their edges fall together.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    kept = least.filter("b = least").select("a", "b")
    moved = least.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return kept.union(moved).distinct()
