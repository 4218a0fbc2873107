"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word is cut into the longest vocabulary piece at its
start, then the longest continuation piece, and so on. Done directly that may
look at a character many times. Here the vocabulary is a trie with failure
links: where the trie has no next character, the link leads to the node that
holds what is left after cutting off whole pieces, and the number of pieces cut
off is stored with the link. Each character of a word is then read once, and
the count is the sum of the popped counts; no piece is ever built.

A word piece that starts a word is marked in the vocabulary (``start_mark``);
the other pieces continue words. A word that cannot be cut into pieces counts
as one unknown token.

Cases: a null, empty or blank text has 0 words and 0 tokens; very long words
are read once from left to right; repeated rows and ids are documents of their
own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered by a task; beyond it the memory starts anew.
MEMORY = 300_000


class WordPieceCounter:
    """Counts greedy word pieces of words given as strings of symbols."""

    def __init__(self, start_pieces: list[str], other_pieces: list[str]):
        # Two roots: 0 reads the start of a word, 1 what follows a cut.
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, start_pieces), (1, other_pieces)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = self.next[node][c]
                ends[node] |= bool(piece)
        # link[v]: the node reached after cutting whole pieces off v's string; popped[v]: how many. -1: impossible.
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([(child, root, c) for root in (0, 1) for c, child in self.next[root].items()])
        while queue:
            node, parent, c = queue.popleft()
            if ends[node]:  # the whole string is a piece
                self.link[node], self.popped[node] = 1, 1
            else:
                at, n = self.link[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    n += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.next[at][c], n
            queue.extend((child, node, d) for d, child in self.next[node].items())

    def count(self, word: str) -> int:
        """Pieces of ``word``; 1 if it cannot be cut into pieces; 0 for no symbols."""
        if not word:
            return 0
        nxt, link, popped = self.next, self.link, self.popped
        node = n = 0
        for c in word:
            while c not in nxt[node]:
                if link[node] < 0:
                    return 1
                n += popped[node]
                node = link[node]
            node = nxt[node][c]
        while node != 1:
            if link[node] < 0:
                return 1
            n += popped[node]
            node = link[node]
        return n


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others follow from code point 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)]


def byte_vocabulary(path: str, start_mark: str | None = None) -> WordPieceCounter:
    """The automaton for a byte-level vocabulary file: pieces that begin with the symbol of a space start
    words (the mark is cut off), the others continue them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = [p for p in spec["model"]["vocab"] if p not in special]
    mark = start_mark or byte_symbols()[0x20]
    return WordPieceCounter([p[1:] for p in vocab if p.startswith(mark) and len(p) > 1],
                            [p for p in vocab if not p.startswith(mark)])


def _count(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    counter, seen = make(), {}
    table = {b: s for b, s in enumerate(byte_symbols())}
    for pdf in batches:
        words_out, tokens_out = [], []
        for text in pdf["_text"]:
            words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
            if len(seen) > MEMORY:
                seen.clear()
            n = 0
            for w in words:
                k = seen.get(w)
                if k is None:
                    k = counter.count(w.decode("latin-1").translate(table))
                    if len(w) <= 64:
                        seen[w] = k
                n += k
            words_out.append(len(words))
            tokens_out.append(n)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": words_out, "n_tokens": tokens_out})


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of whole texts; words are runs outside ASCII white space."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    run = partial(_count, make=partial(byte_vocabulary, vocabulary_path))
    return source.mapInPandas(run, f"doc_id {kind}, n_words long, n_tokens long")
