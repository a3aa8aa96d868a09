"""K-means with bounds that are loosened by the norm of a centroid's total displacement (ns-bounds).

All centroids of all rounds are kept, a few KB each. A vector's row carries its cluster, the distance to that centroid
and the round it was measured in, and for each group of `GROUP` centroids the least distance to one of them (its own
apart) with that round. In round t a bound measured in round s is loosened by the norm of c(t) - c(s), for a group the
largest of its members; drifts of the rounds between are never summed, so to and fro cancels.

A vector whose loosened distance stays below all group bounds keeps its cluster unseen. Otherwise its own distance is
measured; groups whose bound is not above it are rescanned exactly, in whole numbers, and their bounds renewed. A bound
that equals the distance fails, so ties go to the smaller number as they must.

Vectors have exactly `dimensions` components, none null or not finite, as floor(`SCALE` * x); others are left out. Components
of more than 2**26 in size raise an error, as squared distances would leave 64 bits. With fewer vectors than clusters
there are as many clusters as vectors; without any there are no rows. Repeated ids are rows of their own; equal ids have
equal hashes and are ordered by their components; a null id counts as ''. Other columns are not read.

A round writes its rows to the shared folder (about a third of the input), as the next round's input. Sums are made in
each task for each cluster and component, so the driver gets clusters times components numbers, whatever the input.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared

CLUSTERS = 40
DIMENSIONS = 64
ROUNDS = 5
SCALE = 256
SEED = 2
GROUP = 8
LARGEST = 1 << 26
#: Vectors of a batch that are compared at once.
SLICE = 1 << 13

_STATE = ("vec_id long, v array<int>, cluster int, own double, own_at int, lower array<float>, lower_at array<int>")
_FIELDS = ["vec_id", "v", "cluster", "own", "own_at", "lower", "lower_at"]


def whole_vectors(table, dimensions=DIMENSIONS, scale=SCALE, column="embedding"):
    """(vec_id, v) of the vectors that count, as whole numbers."""
    values = F.col(column).cast("array<double>")
    fine = (F.size(values) == dimensions) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(values, lambda x: F.floor(scale * x)).alias("v"))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component is larger than {LARGEST}"))).otherwise(F.col("v").cast("array<int>")).alias("v"))


def first_centroids(rows, clusters=CLUSTERS, seed=SEED):
    """The vectors of the smallest hashes, in their order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(order.alias("place"), "v").orderBy("place", "v").limit(clusters).collect()
    return np.array([row["v"] for row in found], np.int64)


def _matrix(column, kind):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def squared(vectors, centroids):
    """Squared distances in whole numbers, vectors x centroids; no sum leaves 64 bits."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        apart = vectors - centroid
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def displaced(history, group):
    """Per past round: how far each centroid is from where it was, and the largest of each group."""
    moved = np.array([np.sqrt(((history[-1] - past).astype(float) ** 2).sum(axis=1)) for past in history])
    starts = np.arange(0, moved.shape[1], group)
    return moved, np.maximum.reduceat(moved, starts, axis=1)


def _below(x):
    """Rounded down to 32 bits, with room for the rounding of the square roots."""
    return np.nextafter((x * (1 - 1e-6)).astype(np.float32), np.float32(-np.inf))


def assign(vectors, state, history, group=GROUP):
    """The state of the vectors in the round of history[-1], and how many distances it took.

    `state` is (cluster, own, own_at, lower, lower_at), None in the first round.
    """
    now, centroids = len(history) - 1, history[-1]
    n, k = len(vectors), len(centroids)
    starts = np.arange(0, k, group)
    rows = np.arange(n)
    if state is None:
        cluster, own, own_at = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
        lower, lower_at = np.full((n, len(starts)), -np.inf, np.float32), np.zeros((n, len(starts)), np.int64)
        loose_own, loose = own, lower.astype(float)
    else:
        cluster, own, own_at, lower, lower_at = (x.copy() for x in state)
        moved, moved_group = displaced(history, group)
        loose_own = own + moved[own_at, cluster]
        loose = lower.astype(float) - moved_group[lower_at, np.arange(len(starts))]
    asked = np.flatnonzero(~(loose_own * (1 + 1e-9) + 1e-9 < loose.min(axis=1)))
    scanned = len(asked)
    if not len(asked):
        return (cluster, own, own_at, lower, lower_at), 0
    # Its own distance first; then the groups that it does not rule out.
    apart = vectors[asked] - centroids[cluster[asked]]
    nearest = np.einsum("ij,ij->i", apart, apart)
    first, before = cluster[asked].copy(), nearest.copy()
    best = first.copy()
    failed = ~(np.sqrt(nearest.astype(float))[:, None] * (1 + 1e-9) + 1e-9 < loose[asked])
    renewed = {}
    for g, start in enumerate(starts):
        at = np.flatnonzero(failed[:, g])
        if not len(at):
            continue
        distances = squared(vectors[asked[at]], centroids[start:start + group])
        scanned += distances.size
        renewed[g] = at, distances
        least = distances.min(axis=1)
        number = distances.argmin(axis=1) + start
        better = (least < nearest[at]) | ((least == nearest[at]) & (number < best[at]))
        best[at[better]], nearest[at[better]] = number[better], least[better]
    for g, (at, distances) in renewed.items():
        inside = (best[at] >= starts[g]) & (best[at] < starts[g] + distances.shape[1])
        others = distances.astype(float)
        others[np.flatnonzero(inside), best[at[inside]] - starts[g]] = np.inf
        lower[asked[at], g], lower_at[asked[at], g] = _below(np.sqrt(others.min(axis=1))), now
    # The centroid that a vector leaves becomes one of the others of its group, also where that was not rescanned.
    left = np.flatnonzero(best != first)
    at, g = asked[left], first[left] // group
    held = ~failed[left, g]
    at, g, gone = at[held], g[held], np.sqrt(before[left[held]].astype(float))
    lower[at, g], lower_at[at, g] = _below(np.minimum(loose[at, g], gone)), now
    cluster[asked], own[asked], own_at[asked] = best, np.sqrt(nearest.astype(float)), now
    return (cluster, own, own_at, lower, lower_at), scanned


def _round(rows, history, first, group):
    """Rows with their state in the round of history[-1]."""
    history = rows.sparkSession.sparkContext.broadcast(history)

    def assigned(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                state = None if first else (*(batch.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in (("cluster", np.int64), ("own", float), ("own_at", np.int64))),
                                            _matrix(batch.column("lower"), np.float32), _matrix(batch.column("lower_at"), np.int64))
                (cluster, own, own_at, lower, lower_at), _ = assign(_matrix(batch.column("v"), np.int64), state, history.value, group)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(own), pa.array(own_at.astype(np.int32)),
                                                  pa.array(list(lower), pa.list_(pa.float32())), pa.array(list(lower_at.astype(np.int32)), pa.list_(pa.int32()))], _FIELDS)
    return rows.mapInArrow(assigned, _STATE)


def _sums(rows, clusters):
    """(clusters x (1 + components)) exact sums: vectors and components of each cluster, made in the tasks first."""
    def summed(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v, cluster = _matrix(batch.column("v"), np.int64), batch.column("cluster").to_numpy()
                total = np.zeros((clusters, v.shape[1] + 1), np.int64) if total is None else total
                order = np.argsort(cluster, kind="stable")
                there = np.unique(cluster, return_index=False)
                starts = np.searchsorted(cluster[order], there)
                total[there, 1:] += np.add.reduceat(v[order], starts, axis=0)
                total[:, 0] += np.bincount(cluster, minlength=clusters)
        if total is not None:
            k, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(total[k, d])], ["cluster", "at", "total"])
    parts = rows.select("v", "cluster").mapInArrow(summed, "cluster long, at long, total long")
    return parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters x (components + 1)


def moved(centroids, sums):
    """Centroids as the floor of their vectors' means; those without vectors stay."""
    counts = {row["cluster"]: int(row["total"]) for row in sums if row["at"] == 0}
    out = centroids.copy()
    for cluster in counts:
        out[cluster] = 0
    for row in sums:
        if row["at"]:
            out[row["cluster"], row["at"] - 1] = int(row["total"]) // counts[row["cluster"]]
    return out


def clustered(rows, clusters=CLUSTERS, rounds=ROUNDS, seed=SEED, group=GROUP):
    """(vec_id, v, cluster) after the last assignment, and the centroids, for rows (vec_id, v) of whole numbers."""
    rows = shared.stage(rows)
    history = [first_centroids(rows, clusters, seed)]
    if not len(history[0]):
        return rows.withColumn("cluster", F.lit(0)), history[0]
    state = rows
    for t in range(rounds):
        state = shared.stage(_round(state, history, t == 0, group))
        history.append(moved(history[-1], _sums(state, len(history[-1]))))
    return _round(state, history, rounds == 0, group), history[-1]


def op12_centroid_clustering(spark, sf_dir):
    """Each vector with its cluster, its squared distance, the sums of both, and a hash of its centroid."""
    rows, centroids = clustered(whole_vectors(shared.table(spark, sf_dir, "embeddings")))
    if not len(centroids):
        return rows.select("vec_id", "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centre = F.array(*[F.array(*map(F.lit, map(int, c))) for c in centroids])
    apart = F.zip_with("v", F.get(centre, F.col("cluster")), lambda x, y: (x - y).cast("long") * (x - y).cast("long"))
    distance = F.aggregate(apart, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = shared.stage(rows.select("vec_id", "cluster", distance.alias("distance")))
    per_cluster = {row["cluster"]: row["s"] for row in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    inertia = F.array(*[F.lit(per_cluster.get(k, 0)).cast("long") for k in range(len(centroids))])
    texts = F.array(*[F.lit(",".join(map(str, c))) for c in centroids.tolist()])
    return rows.select("vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(per_cluster.values())).cast("long").alias("inertia"),
                       F.sha2(F.get(texts, F.col("cluster")), 256).alias("centroid_sha256"))


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}


def _oracle():
    """The rounds as plain SQL: every distance of every round."""
    steps = [f"""
e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS}
  AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v::DOUBLE))) = {DIMENSIONS}),
p AS MATERIALIZED (SELECT rid, vec_id, unnest(list_transform(x, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT)) AS x, generate_subscripts(x, 1) AS d FROM e),
o AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), rid) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT c, d, x AS y FROM o JOIN p USING (rid) WHERE c < {CLUSTERS})"""]
    for t in range(ROUNDS + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (SELECT rid, min(dc) // {CLUSTERS} AS distance, min(dc) % {CLUSTERS} AS c FROM
  (SELECT rid, sum((x - y) * (x - y))::BIGINT * {CLUSTERS} + c AS dc FROM p JOIN c{t} USING (d) GROUP BY rid, c) GROUP BY rid)""")
        if t < ROUNDS:
            steps.append(f"""
s{t} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN a{t} USING (rid) GROUP BY c, d),
c{t + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{t} LEFT JOIN s{t} USING (c, d))""")
    return "WITH " + ",".join(steps) + f""",
h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (rid) JOIN h USING (c)"""


ORACLES = {"op12_centroid_clustering": _oracle()}
