import hashlib
import random

import numpy as np
import pytest

from groundwork.llm import centroid_clustering as c

ROWS = "vec_id long, embedding array<float>, cluster string, v string"


def plain(vectors, clusters, rounds):
    """(assignment, centroids, history) of (vec_id, whole vector) by the definition."""
    order = sorted(range(len(vectors)), key=lambda k: (hashlib.sha256(f"2:{vectors[k][0]}".encode()).hexdigest(), vectors[k][1]))
    centroids = [list(vectors[k][1]) for k in order[:clusters]]
    for t in range(rounds + 1):
        cluster = [min(range(len(centroids)), key=lambda j: (sum((x - y) ** 2 for x, y in zip(v, centroids[j])), j)) for _, v in vectors]
        if t < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), k in zip(vectors, cluster) if k == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return cluster, centroids


def vectors(seed, n, dimensions, spread):
    rng = random.Random(seed)
    centres = [[rng.randrange(-spread, spread) for _ in range(dimensions)] for _ in range(9)]
    return [(k, [x + rng.randrange(-spread // 3, spread // 3 + 1) for x in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("seed,n,clusters,group,spread", [(0, 500, 12, 4, 40), (1, 300, 7, 3, 4), (2, 6, 20, 8, 40), (3, 400, 10, 1, 100), (4, 200, 5, 40, 2)])
def test_against_plain_rounds(spark, seed, n, clusters, group, spread):
    data = vectors(seed, n, 5, spread)
    rows = spark.createDataFrame(data, "vec_id long, v array<int>").repartition(5)
    out, centroids = c.clustered(rows, clusters, 5, group=group)
    cluster, want = plain(data, clusters, 5)
    assert centroids.tolist() == want
    assert {r["vec_id"]: r["cluster"] for r in out.collect()} == {k: j for (k, _), j in zip(data, cluster)}


def test_bounds_spare_distances_and_loosen_by_total_displacement():
    data = np.array([v for _, v in vectors(7, 3000, 6, 400)])
    history, state, scanned = [data[:9].copy()], None, []
    for t in range(8):
        state, n = c.assign(data, state, history, 3)
        scanned.append(n)
        cluster = state[0]
        assert (cluster == c.squared(data, history[-1]).argmin(axis=1)).all()
        history.append(np.array([data[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else history[-1][j] for j in range(9)]))
    assert scanned[0] >= 27000 and scanned[-1] < scanned[0] / 4
    # Centroids that return to where they were loosen no bound at all.
    away = [history[-1], history[-1] + 50, history[-1]]
    moved, of_group = c.displaced(away, 3)
    assert not moved[0].any() and not of_group[0].any() and moved[1].min() > 100


def test_only_whole_vectors_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 64), (2, [0.5] * 63), (3, [0.5] * 65), (4, [None] + [0.5] * 63), (5, [nan] + [0.5] * 63), (6, [inf] + [0.5] * 63), (7, None), (8, []), (9, [-0.001] * 64)]
    frame = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], ROWS)
    got = {r["vec_id"]: r["v"] for r in c.whole_vectors(frame).collect()}
    assert got == {1: [128] * 64, 9: [-1] * 64}
    out, centroids = c.clustered(c.whole_vectors(frame))
    assert sorted((r["vec_id"], r["cluster"]) for r in out.collect()) == sorted((k, [row.tolist() for row in centroids].index([128] * 64 if k == 1 else [-1] * 64)) for k in (1, 9))


def test_equal_rows_ties_null_ids_and_large_components(spark):
    rows = spark.createDataFrame([(None, [1, 1]), (5, [1, 1]), (5, [1, 1]), (6, [3, 3]), (7, [2, 2])], "vec_id long, v array<int>")
    out, centroids = c.clustered(rows, 3, 0)
    distances = c.squared(np.array([[1, 1], [3, 3], [2, 2]]), centroids)
    found = {tuple(r["v"]): r["cluster"] for r in out.collect()}
    assert [found[k] for k in ((1, 1), (3, 3), (2, 2))] == distances.argmin(axis=1).tolist()
    assert out.count() == 5
    large = spark.createDataFrame([(1, [1e9] * 64, "", "")], ROWS)
    with pytest.raises(Exception, match="larger than"):
        c.whole_vectors(large).collect()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], ROWS)
    out, centroids = c.clustered(c.whole_vectors(empty))
    assert out.count() == 0 and len(centroids) == 0
    empty.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = c.op12_centroid_clustering(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
