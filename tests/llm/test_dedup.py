import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from cases import documents, empty, rows, words

from latebound.llm.phrase_dedup import repeated_phrases
from latebound.llm.rolling import WordHasher, runs, sliding_min, windows
from latebound.llm.suffix_dedup import SUFFIX, _neighbours, kept_positions, repeated_passages


def plain_phrases(docs, window=13):
    """Words covered by a window that also starts in a document with a smaller id."""
    owner = {}
    for ident, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if ident is not None:
                owner[key] = min(owner.get(key, ident), ident)
    out = []
    for ident, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if ident is not None and owner[tuple(w[i:i + window])] < ident:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((ident, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_values": 15, "chunk_bytes": 2000}])
def test_phrases_equal_the_plain_ones(spark, options):
    out = repeated_phrases(documents(spark), **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_phrases([r[:2] for r in rows()])
    assert repeated_phrases(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrases_of_few_words(spark, seed):
    """A small vocabulary: passages overlap, repeat inside documents and touch."""
    rnd = random.Random(seed)
    docs = [(i, " ".join(rnd.choice(["a", "b"]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    for i in range(60, 100):
        a = rnd.randint(0, 30)
        b = rnd.randint(a, 40)
        docs.append((i, " ".join([f"x{i}"] * rnd.randint(0, 3) + passage[a:b] + passage[:rnd.randint(0, 20)] + [f"y{i}"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = repeated_phrases(df, shard_values=20, chunk_bytes=500).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_phrases(docs)


def test_kept_text(spark):
    p = " ".join(f"p{i}" for i in range(13))
    df = spark.createDataFrame([(1, f"a {p} b"), (2, f"c\n{p}  d"), (3, "e f")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in repeated_phrases(df).collect()}
    assert got == {1: (0, None), 2: (13, "c d"), 3: (0, None)}


def plain_passages(docs, size):
    """Words covered by windows of ``size`` words that occur twice or more anywhere."""
    count = {}
    for _, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            count[key] = count.get(key, 0) + 1
    out = []
    for ident, text in docs:
        w = words(text)
        mask = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                mask[i:i + size] = True
        out.append((ident, len(w), int(mask.sum()), runs(mask)))
    return sorted(out, key=str)


def found_passages(df, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_repeated"], [(s["from"], s["to"]) for s in r["spans"]])
                   for r in repeated_passages(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{"min_words": 50}, {"min_words": 20, "key_words": 10, "gram": 4}])
def test_passages_equal_the_plain_ones(spark, options):
    assert found_passages(documents(spark), **options) == plain_passages([r[:2] for r in rows()], options["min_words"])
    assert repeated_passages(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    rnd = random.Random(seed)
    word = iter(range(10**9))
    new = lambda n: [f"u{next(word)}" for _ in range(n)]
    passages = [new(rnd.randint(50, 130)) for _ in range(6)]
    docs = []
    for i in range(120):
        text = new(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 2)):
            text += passages[min(rnd.randint(0, 5), rnd.randint(0, 5))] + new(rnd.randint(0, 60))
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found_passages(df) == plain_passages(docs, 50)


def versions(copies=40, seed=9):
    """Versions of a notice round one key of 25 words: many share more to the left, others more to the right."""
    rnd = random.Random(seed)
    left, key, right = ([f"{c}{i}" for i in range(60)] for c in "lkr")
    out = []
    for i in range(copies):
        a, b = rnd.randint(0, 40), rnd.randint(0, 40)
        own = lambda n: [f"o{i}_{j}_{rnd.random()}" for j in range(n)]
        out.append((i, " ".join(own(rnd.randint(0, 30)) + left[60 - a:] + key[:25] + right[:b] + own(rnd.randint(0, 30)))))
    return out


@pytest.mark.parametrize("seed", [9, 10, 11])
def test_third_suffix_between_two_that_match(spark, seed):
    docs = versions(seed=seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found_passages(df) == plain_passages(docs, 50)


def test_neighbours_extend_both_ways_by_words():
    left, right = [b"l%d" % i for i in range(25)], [b"r%d" % i for i in range(50)]

    def row(n, a, b, key=1):
        behind, before = right[:b] + [b"x%d" % n] * (50 - b), left[:a] + [b"y%d" % n] * (25 - a)
        wins = windows(WordHasher()(before[::-1] + behind), 50).tobytes()
        return key, True, n, 100, 0, 25, b" ".join(behind), b" ".join(before), wins

    frame = pd.DataFrame([row(1, 12, 40), row(2, 20, 40), row(3, 5, 40), row(4, 20, 25), row(5, 25, 50, key=2)], columns=SUFFIX)
    out = pd.concat(_neighbours(50, True)(iter([frame])))
    spans = out[out["kind"] == 0][["row", "from", "to"]].values.tolist()
    assert spans == [[1, 88, 140], [2, 88, 140]]               # 12 to the left, 40 to the right; 3 shares 45 words only
    assert out[out["kind"] == 1]["row"].tolist() == [1, 5]
    wins = out[out["kind"] == 2]
    assert sorted(wins[wins["row"] == 1].query("many")["low"]) == [10, 11, 12]
    a, b = wins[(wins["row"] == 1) & wins["many"]], wins[(wins["row"] == 2) & wins["many"]]
    assert a["hash"].tolist() == b["hash"].tolist() and wins["hash"].nunique() > 90


def test_short_repeats_stay(spark):
    p = " ".join(f"p{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"a {p} b"), (2, f"c {p} d")], "doc_id long, text string")
    assert [r["n_repeated"] for r in repeated_passages(df).collect()] == [0, 0]


def test_rolling_helpers():
    h = WordHasher()([b"a", b"b", b"a", b"b", b"c"])
    two = windows(h, 2)
    assert two[0] == two[2] != two[1] and len(windows(h, 6)) == 0
    values = np.array([5, 3, 9, 1, 4, 4], dtype=np.uint64)
    for size in range(1, 8):
        want = [min(values[i:i + size]) for i in range(len(values) - size + 1)]
        assert sliding_min(values, size).tolist() == want
    at = kept_positions(WordHasher()([str(i).encode() for i in range(400)]), 50, 25, 8)
    assert np.diff(at).max() <= 26 and at[0] <= 25 and at[-1] >= 400 - 50
    assert runs(np.array([True, False, True, True])) == [(0, 1), (2, 4)]


def test_ranges_of_one_suffix(spark):
    rnd = random.Random(4)
    key = [f"k{i}" for i in range(25)]  # shared, but too short for a passage
    docs = [(i, " ".join([f"a{i}_{j}" for j in range(60)] + key + [f"b{i}_{j}" for j in range(rnd.randint(50, 60))]))
            for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert found_passages(df, min_words=26, key_words=20, gram=4) == plain_passages(docs, 26)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


@pytest.mark.parametrize("seed", range(3))
def test_passages_between_others_of_the_same_key(spark, seed):
    """Notices with a common middle and varying words around it: neighbours in neither order share a passage, others do."""
    rnd = random.Random(seed)
    middle = [f"m{i}" for i in range(25)]
    left, right = [f"l{i}" for i in range(60)], [f"r{i}" for i in range(60)]
    docs = []
    for i in range(60):
        a, b = rnd.randint(0, 30), rnd.randint(0, 50)
        docs.append((i, " ".join([f"x{i}_{j}" for j in range(40)] + left[60 - a:] + middle + right[:b]
                                 + [f"{rnd.choice('yz')}{i}_{j}" for j in range(40)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found_passages(df) == plain_passages(docs, 50)
