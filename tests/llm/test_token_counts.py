import random

from cases import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from latebound.llm.queries import tokenizer_path
from latebound.llm.token_counts import WordPieceCounter, byte_symbols, byte_vocabulary, token_counts


def greedy(word, start, other):
    n, at = 0, 0
    while at < len(word):
        pieces = start if at == 0 else other
        end = next((e for e in range(min(len(word), at + 200), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
       st.lists(st.text("abcd", max_size=14), min_size=1, max_size=8))
def test_counts_equal_greedy_longest_match(start, other, words):
    counter = WordPieceCounter(sorted(start), sorted(other))
    for w in words:
        assert counter.count(w) == greedy(w, start, other), w


def test_counts_with_the_public_vocabulary(spark):
    import json

    path = tokenizer_path("byte_bpe_50k.json")
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    mark = byte_symbols()[32]
    start, other = {p[1:] for p in vocab if p[0] == mark and len(p) > 1}, {p for p in vocab if p[0] != mark}
    want = sorted(((r[0], len(w), sum(greedy("".join(byte_symbols()[b] for b in x), start, other) for x in w))
                   for r in rows() for w in [(r[1] or "").encode().split()]), key=str)
    assert sorted((tuple(r) for r in token_counts(documents(spark), path).collect()), key=str) == want
    assert token_counts(empty(spark), path).count() == 0


def test_long_words_take_linear_time():
    import time

    counter = byte_vocabulary(tokenizer_path("byte_bpe_50k.json"))
    rnd, times = random.Random(1), []
    for n in (50_000, 400_000):
        word = "".join(rnd.choice("abcdeaaa") for _ in range(n))
        began = time.process_time()
        counter.count(word)
        times.append(time.process_time() - began)
    assert times[1] < 30 * max(times[0], 0.01)
