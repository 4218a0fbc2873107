import itertools
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from latebound.llm.toxicity import (ORDER, SYMBOLS, Restorer, _letter_table, decode, fold, gram_codes, language_model,
                                    lattice, smoothed, symbol, toxicity_scores)

from cases import documents, empty

INSULTS = ["idiot", "stupid", "moron", "pathetic", "worthless"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["the", "re", "tion", "an", "ou", "en", "st", "wh", "ing", "ly"])
                            for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=600, seed=4):
    """Rows ``id, text, toxic``; a third of the toxic documents hide their insult."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        text, toxic = prose(rnd, rnd.randint(10, 60)), int(i % 4 == 0)
        if toxic:
            words = text.split()
            for _ in range(2):
                w = rnd.choice(INSULTS)
                if i % 12 == 0:
                    w = rnd.choice([hide for hide in disguises(w)])
                words.insert(rnd.randint(0, len(words)), w)
            text = " ".join(words)
        out.append((i, text, toxic))
    return out


def disguises(w):
    leet = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$", "t": "7"})
    return [w.translate(leet), ".".join(w), " ".join(w), w[:-2] + w[-2] * 4 + w[-1]]


@pytest.fixture(scope="module")
def model():
    counts = Counter()
    codes = gram_codes([t for _, t, _ in corpus()], _letter_table())
    counts = np.bincount(codes, minlength=SYMBOLS ** ORDER)
    return smoothed(counts)


def test_language_model_counts_whole_corpus(spark):
    texts = ["Ab cd", None, "", "x--y  Éa", "日本 ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    counts = np.zeros(SYMBOLS ** ORDER, dtype=np.int64)
    for t in texts:
        for w in "".join(c if symbol(c) else " " for c in fold(t or "")).split():
            s = [0] * (ORDER - 1) + [symbol(c) for c in w] + [0]
            for k in range(len(s) - ORDER + 1):
                code = 0
                for c in s[k:k + ORDER]:
                    code = code * SYMBOLS + c
                counts[code] += 1
    got, want = language_model(df), smoothed(counts)
    assert np.isfinite(got).all() and np.exp(got.reshape(-1, SYMBOLS)).sum(axis=1) == pytest.approx(1, abs=1e-4)
    assert counts.sum() > 10 and (got == want).all()


def brute(chars, model):
    """Least cost over all paths of the lattice."""
    low = math.inf
    for path in itertools.product(*lattice(chars), [((0,), 0.0)]):
        at, cost = 0, 0.0
        for symbols, extra in path:
            cost += extra
            for s in symbols:
                if s or at:
                    cost -= float(model[at * SYMBOLS + s])
                    at = (at * SYMBOLS + s) % SYMBOLS ** (ORDER - 1) if s else 0
        low = min(low, cost)
    return low


def cost_of(words, chars, model):
    """Least cost of the paths that give these words."""
    low = math.inf
    for path in itertools.product(*lattice(chars), [((0,), 0.0)]):
        at, cost, line = 0, 0.0, []
        for symbols, extra in path:
            cost += extra
            for s in symbols:
                if s or at:
                    cost -= float(model[at * SYMBOLS + s])
                    at = (at * SYMBOLS + s) % SYMBOLS ** (ORDER - 1) if s else 0
                    line.append(" " if s == 0 else "?" if s == 27 else chr(96 + s))
        if "".join(line).split() == words:
            low = min(low, cost)
    return low


@pytest.mark.parametrize("chars", ["1d10t", "st*pid", "i.d.i", "m0r0n", "heyyyy", "a1!b", "i d i o t", "77", "x@@y"])
def test_viterbi_finds_the_best_path(chars, model):
    words = decode(chars, model)
    assert cost_of(words, chars, model) == pytest.approx(brute(chars, model), abs=1e-4)


def test_restores_disguises(model):
    r = Restorer(model)
    for w in INSULTS:
        for hidden in disguises(w):
            assert w in r.words(f"the {hidden} and"), hidden
    assert r.words("The trash, THE Élan--x 2024 $$$") == {"the", "trash", "elan", "x"}
    assert r.text("You 1d10t, go. A plain text!") == "You idiot go. A plain text!"
    assert r.words(None) == r.words("") == set() and r.text(None) is None


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels, with_text=True).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        r = got[i]
        assert r["held_out"] == (crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    out = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(out) > 80 and sum(p == y for p, y in out) >= 0.97 * len(out)
    # held-out labels have no influence
    flipped = spark.createDataFrame([(i, 0, 1 - y if got[i]["held_out"] else y) for i, _, y in rows],
                                    "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, flipped).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], abs=1e-9) for i in got)


def test_odd_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark)
    got = toxicity_scores(docs, none).collect()
    assert len(got) == docs.count() and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in got)
    assert toxicity_scores(empty(spark), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (10**9, 1), (7, 0), (13, 1)], "doc_id long, toxic int")
    got = toxicity_scores(docs, odd, with_text=True).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["restored"] for r in got if r["doc_id"] == 1} == {None}
