import numpy as np
import pytest

from latebound.llm.whitening import by_component, whitened_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, idx string, x string, y string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, *["x"] * 4)
                                  for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=4):
    """Expected figures by vector id: n, deviation, projection (any sign), explained."""
    sound = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows
             if v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in sound}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [(i, n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), (x - s / n) @ u / np.sqrt(e), e / np.trace(cov))
            for i, x in sound]


@pytest.mark.parametrize("block", [16, 1024])
def test_projection_equals_numpy(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 8)) @ rng.standard_normal((8, 8))
    rows = [(i * 3, v) for i, v in enumerate(base)] + [(9000 + i, base[0]) for i in range(150)]  # a large group of copies
    rows += [(7000, None), (7001, []), (7002, [1.0] * 7 + [None]), (7003, [1.0] * 7 + [float("nan")]),
             (7004, [1.0] * 7 + [float("-inf")]), (7005, [1.0] * 5), (None, base[1]), (3, base[1])]
    got = by_component(whitened_vectors(frame(spark, rows), rows_per_block=block)).collect()
    want = plain(rows)
    assert len(got) == 4 * len(want)
    key = lambda r: (str(r[0]), r[2])
    mine = {}
    for r in got:
        mine.setdefault((str(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], r)
    signs = None
    for i, n, dev, y, share in sorted(want, key=key):
        r = mine[str(i), dev]
        assert all(r[j]["n"] == n and r[j]["identity_error"] < 1e-9 for j in r)
        assert np.allclose([r[j]["explained"] for j in (1, 2, 3, 4)], share, rtol=1e-9)
        found = np.array([r[j]["whitened"] for j in (1, 2, 3, 4)])
        signs = np.sign(found * y) if signs is None else signs
        assert np.allclose(found, signs * y, rtol=1e-8, atol=1e-9)


def test_nothing_to_whiten(spark):
    assert whitened_vectors(frame(spark, [])).count() == 0
    alone = whitened_vectors(frame(spark, [(1, [0.5] * 8), (2, [0.5] * 8)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"]) for r in alone] == [(1, 0, [])] * 2
    flat = whitened_vectors(frame(spark, [(1, [0.5] * 8), (2, [0.25] * 8), (3, [0.25] * 8)])).collect()
    assert all(len(r["whitened"]) == 1 and r["explained"] == [pytest.approx(1.0)] for r in flat)
    assert sorted(round(abs(r["whitened"][0]), 9) for r in flat) == [1.0] * 3
