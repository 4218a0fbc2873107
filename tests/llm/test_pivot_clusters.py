import hashlib

import numpy as np
import pytest

from latebound.llm.pivot_clusters import centroid_clusters, digest, lower_bounds, nearest, pivot_distances, squared

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, pivots string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, *["z"] * 4)
                                  for i, v in rows], SCHEMA).repartition(3)


def plain(rows, dim, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(x) for _, x in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(centres)):
            mine = [x for (_, x), (_, t) in zip(kept, to) if t == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    to = assign()
    of = [sum(d for d, t in to if t == j) for j in range(len(centres))]
    return sorted(((i, t, d, of[t], sum(of), hashlib.sha256(",".join(map(str, centres[t])).encode()).hexdigest())
                   for (i, _), (d, t) in zip(kept, to)), key=str)


def found(spark, rows, **options):
    out = centroid_clusters(frame(spark, rows), **options).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest("centroid"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i * 2 + 1, rng.standard_normal(dim) + 3 * (i % 5)) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(150)]       # equal vectors
    rows += [(7000, None), (7001, []), (7002, [None] * dim), (7003, [float("nan")] * dim), (7004, [float("inf")] * dim),
             (7005, [1.0] * (dim - 1)), (None, rows[3][1]), rows[4]]
    return rows


@pytest.mark.parametrize(("seed", "pivots"), [(1, 16), (2, 3)])
def test_equals_plain_clustering(spark, seed, pivots):
    rows = vectors(seed)
    assert found(spark, rows, dim=8, pivots=pivots) == plain(rows, 8)


def test_ties_and_few_vectors(spark):
    grid = [(i, [(i % 4) / 64.0, (i // 4 % 4) / 64.0]) for i in range(64)]     # many equal distances, repeated vectors
    assert found(spark, grid, dim=2, k=7) == plain(grid, 2, k=7)
    few = [(1, [0.0, 1.0]), (2, [5.0, 1.0])]
    assert found(spark, few, dim=2) == plain(few, 2)
    assert found(spark, [], dim=2) == []
    with pytest.raises(Exception, match="components beyond"):
        found(spark, [(1, [1e9, 0.0])], dim=2)


def test_pivots_rule_out_centroids_without_loss():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (12, 4))
    x = centres[rng.integers(0, 12, 4000)] + rng.integers(-20, 20, (4000, 4))
    table, own = pivot_distances(x, centres[:4]), pivot_distances(centres, centres[:4])
    number, best, used = nearest(x, table, centres, own)
    every = np.stack([squared(x, c) for c in centres], axis=1)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert used < 3 * len(x)                                    # of 12 distances a vector
    assert (lower_bounds(table, own) ** 2 * np.sign(lower_bounds(table, own)) <= every).all()
