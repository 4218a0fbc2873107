import random

import numpy as np
import pytest
import xxhash
from cases import collected, documents, empty, rows, words

from latebound.llm.components import connected_components
from latebound.llm.simhash import (allocate, bit_counts, group_bits, link_fingerprints, one_per_group, plan_parts,
                                   simhash_groups)


def plain_print(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    n, shingles = [0] * 64, [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def plain_groups(prints, bits):
    """Least id reachable, for (id, print) pairs."""
    ids = list(range(len(prints)))
    group = list(ids)
    for i in ids:
        for j in ids[:i]:
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for i in ids:
        if prints[i][0] is not None:
            least[group[i]] = min(least.get(group[i], prints[i][0]), prints[i][0])
    return [least.get(g) for g in group]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_the_plain_ones(spark, seed):
    prints = [(r[0], plain_print(r[1])) for r in rows(seed)]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_groups(prints, 4))), key=str)
    got = sorted((tuple(r) for r in simhash_groups(documents(spark, seed)).collect()), key=str)
    assert got == want
    assert simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize(("max_bits", "tile"), [(4, 512), (4, 5), (2, 3), (6, 20), (0, 4)])
def test_links_of_random_and_hot_prints(spark, max_bits, tile):
    rnd = random.Random(max_bits * 100 + tile)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = {0, (1 << 64) - 1, *base}
    for b in [base[0]] * 60 + base[:20]:                       # one large group, and pairs
        for _ in range(rnd.randint(1, 7)):
            b ^= 1 << rnd.randrange(64)
            prints.add(b)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in link_fingerprints(df, max_bits, tile).collect()}
    want = plain_groups(list(zip(signed, prints)), max_bits)
    assert [got.get(x, x) for x in signed] == want


def test_thresholds_cover_and_follow_the_counts():
    both = np.full((64, 64), 0.25) * 1000
    np.fill_diagonal(both, 500)
    both[:8, :8] = 500  # eight bits that are always equal
    groups = group_bits(1000, both, 5)
    assert any(set(range(8)) <= set(g) for g in groups) and sorted(sum(groups, [])) == list(range(64))
    for n in (10, 10**6, 10**10):
        parts = plan_parts(n, both, 4)
        assert sum(t + 1 for _, t in parts) == 5
    cost, ts = allocate(10**10, np.diag(both) / 1000, group_bits(1000, both, 2), 4, 20.0)
    assert sorted(ts) == [1, 2] and cost > 0


def test_bit_counts(spark):
    df = spark.createDataFrame([(3,), (1,), (-1,)], "fp long")
    n, both = bit_counts(df)
    assert n == 3 and both[0, 1] == 2 and both[0, 0] == 3 and both[63, 62] == 1
    assert bit_counts(df.limit(0))[0] == 0


def test_one_per_group(spark):
    docs = documents(spark)
    kept = one_per_group(docs)
    groups = simhash_groups(docs).collect()
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r["component_id"]) for r in groups})
    assert set(collected(kept)) <= set(collected(docs))
    assert one_per_group(empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    group = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                for v in y:
                    group[v] = x
    assert got == {v: min(s) for v, s in group.items()}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0
