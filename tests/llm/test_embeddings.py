import numpy as np
import pytest

from latebound.llm.nn_descent import near_vectors, orders_for

SCHEMA = "vec_id long, embedding array<float>, label int, id string, root string, vec string"


def plain(vectors, threshold=0.95):
    sound = [i for i, (_, v) in enumerate(vectors) if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v)
             and any(v)]
    x = np.array([vectors[i][1] for i in sound], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    links, group = dict.fromkeys(range(len(vectors)), 0), list(range(len(vectors)))
    for a, i in enumerate(sound):
        links[i] = int(near[a].sum()) - 1
    label = np.arange(len(sound))
    while True:
        low = np.where(near, label[None, :], len(sound)).min(axis=1)
        if (low == label).all():
            break
        label = low
    least = {}
    for a, i in enumerate(sound):
        least[label[a]] = min(least.get(label[a], 10**9), vectors[i][0])
    for a, i in enumerate(sound):
        group[i] = least[label[a]]
    comp = [group[i] if i in set(sound) else vectors[i][0] for i in range(len(vectors))]
    return sorted((v[0], links[i], comp[i], comp[i] == v[0]) for i, v in enumerate(vectors))


def vectors(seed):
    rng = np.random.default_rng(seed)
    out, ident = [], iter(range(1, 10**6))
    add = lambda v: out.append((next(ident) * 2, None if v is None else [None if c is None else float(c) for c in v]))
    for _ in range(300):
        add(rng.standard_normal(16))
    centre = rng.standard_normal(16)
    for _ in range(150):                                       # one large group of near copies
        add(centre + 0.08 * rng.standard_normal(16))
    for _ in range(40):                                        # pairs and a chain
        v = rng.standard_normal(16)
        add(v)
        add(3 * v + 0.1 * rng.standard_normal(16))
    for _ in range(60):                                        # equal vectors
        add(centre)
    for bad in (None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 3):
        add(bad)
    order = rng.permutation(len(out))
    return [(out[i][0], out[j][1]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"tile": 32, "block": 32, "keep": 4, "most": 8})])
def test_links_and_components(spark, seed, options):
    data = vectors(seed)
    df = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in data], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in near_vectors(df, **options).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == plain(data)


def test_none_and_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty).count() == 0
    rows = [(None, [1.0, 0.0], 0, "", "", ""), (4, [1.0, 0.0], 0, "", "", ""), (4, [2.0, 0.0], 0, "", "", ""), (9, None, 0, "", "", "")]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True)], key=str)


def linked_groups(rng, size, dim=16):
    """Two tight groups whose members lie just over the threshold from each other, as rows ``id, vector``."""
    a = rng.standard_normal(dim)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(dim)
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    far = 0.9515 * a + np.sqrt(1 - 0.9515 ** 2) * b
    out = [c + 0.001 * rng.standard_normal(dim) for c in (a, far) for _ in range(size)]
    return [(i * 2 + 2, [float(c) for c in v]) for i, v in enumerate(out)]


def found(spark, data, **options):
    df = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in data], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in near_vectors(df, **options).select("vec_id", "n_links", "component_id", "kept").collect())


def test_links_of_full_lists_are_not_lost(spark):
    data = linked_groups(np.random.default_rng(5), 300)
    want = plain(data)
    assert len({r[2] for r in want}) == 1
    assert found(spark, data) == want


def test_audit_secures_what_the_search_misses(spark):
    rng = np.random.default_rng(6)
    data = []
    for _ in range(200):                                       # pairs near the threshold with no other neighbour
        v = rng.standard_normal(16)
        data += [v, v + 0.3 * rng.standard_normal(16) * np.linalg.norm(v) / 4]
    data = [(i * 2 + 2, [float(c) for c in v]) for i, v in enumerate(data)]
    assert found(spark, data, orders=1, block=4, attempts=1, audit=20, audit_linked=10) == plain(data)


def test_orders_grow_with_the_table():
    few, many = (orders_for(n, 128, 0.95, 0.999) for n in (10_000, 20_000_000))
    assert 1 < few < many and orders_for(50, 128, 0.95, 0.999) == 1
