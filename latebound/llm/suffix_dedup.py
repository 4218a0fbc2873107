"""Repeated passages by a sparse suffix array.

A suffix array sorts all suffixes and compares neighbours. Here only suffixes
at content-selected places are kept: of every ``min_words - key_words + 1``
consecutive word positions, the one whose ``gram``-word group has the least
hash. So every window of ``min_words`` words holds a kept suffix that goes on
for at least ``key_words`` words inside the window, at the same place in every
copy, and about one position of thirteen is kept (50 and 25 words). That suffix
owns the window (the one of the least group, if it holds several).

1. Documents with equal texts are found by a digest, and one stands for all.
   Suffixes are keyed by a hash of their first ``key_words`` words; keys that
   occur once have no copy and go (a count, summed before the shuffle).
2. The others come with the words to their right and left that a window around them can
   hold, and are sorted by key and following words over range partitions, so a
   key that a third of all suffixes have is many ranges.
3. Neighbours of one key are compared word by word and the match is extended to the right and
   to the left; ``min_words`` words or more are a passage. The first and last
   suffixes of all ranges are compared in a second, small pass.
4. Sorted neighbours agree far to the right, but a third suffix may stand between two that agree
   further to the left. So where a key occurs three times or more, the windows of its suffixes
   that no neighbour matched are looked up by key and hash among all windows of the key;
   those with a twin are compared by their words.

Matched words of a document are joined to spans.

Cases: null, empty and short texts have no spans; a passage that occurs twice
in one document counts; equal ids and repeated rows are documents of their own
(a repeated row repeats all its words); very long texts are treated whole; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import WordHasher, runs, windows
from .stages import discard, written
from .words import byte_words, common

#: A kept suffix: its key, whether three or more have it, where it is, the windows it owns (numbers of words to the
#: left of it, from ``low`` to ``high``), the words from it on, the words before it, nearest first, and of frequent
#: keys the hashes of its windows in the order of the text (8 bytes each).
SUFFIX = ["key", "many", "row", "place", "low", "high", "right", "left", "wins"]
SUFFIX_SCHEMA = "key long, many boolean, row long, place long, low int, high int, right binary, left binary, wins binary"

def window_places(hashes: np.ndarray, min_words: int, key_words: int, gram: int) -> np.ndarray:
    """For each window of ``min_words`` words the position of its kept suffix (the first of equal least groups)."""
    span = min_words - key_words + 1
    groups = windows(hashes, gram)[: max(0, len(hashes) - key_words + 1)]
    if len(groups) < span:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(groups, span)
    return np.concatenate([view[i:i + 4096].argmin(axis=1) + np.arange(i, min(i + 4096, len(view)))
                           for i in range(0, len(view), 4096)])


def kept_positions(hashes: np.ndarray, min_words: int, key_words: int, gram: int) -> np.ndarray:
    """Positions of kept suffixes."""
    return np.unique(window_places(hashes, min_words, key_words, gram))


def _suffix_keys(min_words: int, key_words: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for pdf in batches:
            keys, places = [], []
            for text in pdf["text"]:
                h = hasher(byte_words(text))
                at = kept_positions(h, min_words, key_words, gram)
                places.append(at)
                keys.append(windows(h, key_words)[at].view(np.int64))
            n = [len(p) for p in places]
            yield pd.DataFrame({"row": pdf["row"].repeat(n).to_numpy(),
                                "place": np.concatenate(places) if n else np.empty(0, dtype=np.int64),
                                "key": np.concatenate(keys) if n else np.empty(0, dtype=np.int64)})

    return run


def _cut_out(min_words: int, key_words: int, gram: int):
    """The kept suffixes of ``found`` (place, key, many) with their words."""
    before = min_words - key_words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for pdf in batches:
            rows = []
            for row, text, found in zip(pdf["row"], pdf["text"], pdf["found"]):
                words = byte_words(text)
                h = hasher(words)
                owner = window_places(h, min_words, key_words, gram)  # rising, as windows go on
                hashes = windows(h, min_words)
                places = np.array([f["place"] for f in found], dtype=np.int64)
                first, stop = np.searchsorted(owner, places), np.searchsorted(owner, places, side="right")
                for f, p, a, b in zip(found, places.tolist(), first.tolist(), stop.tolist()):
                    rows.append((f["key"], f["many"], row, p, p - b + 1, p - a, b" ".join(words[p:p + min_words]),
                                 b" ".join(words[max(0, p - before):p][::-1]), hashes[a:b].tobytes() if f["many"] else b""))
                    if len(rows) >= 5_000:
                        yield pd.DataFrame(rows, columns=SUFFIX)
                        rows = []
            yield pd.DataFrame(rows, columns=SUFFIX)

    return run


class Around:
    """A suffix among its sorted neighbours: the words it matches with them to its left and right."""

    def __init__(self, key, many, row, place, low, high, right, left, wins):
        self.raw = (key, many, row, place, low, high, right, left, wins)
        self.key, self.row, self.place, self.low, self.high, self.wins = key, row, place, low, high, wins
        self.right, self.left, self.reach = right.split(), left.split(), []

    def compare(self, other: Around, min_words: int) -> None:
        """Extends the match with the next suffix in the order both ways."""
        if self.key == other.key and (self.row, self.place) != (other.row, other.place):
            both = common(self.left, other.left), common(self.right, other.right)
            if sum(both) >= min_words:
                self.reach.append(both)
                other.reach.append(both)

    def span(self) -> tuple[int, int, int] | None:
        if self.reach:
            return (self.row, self.place - max(r[0] for r in self.reach), self.place + max(r[1] for r in self.reach))
        return None

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words to the left of the suffix in each window it owns, whether a neighbour matched it, and its hash."""
        offs = np.arange(self.high, self.low - 1, -1)
        known = np.zeros(len(offs), dtype=bool)
        for left, right in self.reach:
            known |= (offs <= left) & (offs >= min_words - right)
        return offs, known, np.frombuffer(self.wins, dtype="<i8")


#: Spans (``kind`` 0), first and last suffixes of ranges (1), and windows of frequent keys (2; ``low`` is the number
#: of words before the suffix, ``many`` whether a neighbour matched it, ``hash`` its hash). Unused columns hold zeros.
FOUND = ["kind", "from", "to", "hash", *SUFFIX]
FOUND_SCHEMA = f"kind int, from long, to long, hash long, {SUFFIX_SCHEMA}"


def _frame(kind: int, n: int, **columns) -> pd.DataFrame:
    empty = {c: np.zeros(n, dtype=np.int64) for c in FOUND} | {
        "kind": np.full(n, kind), "many": np.zeros(n, dtype=bool), "right": [b""] * n, "left": [b""] * n, "wins": [b""] * n}
    return pd.DataFrame({**empty, **columns}, columns=FOUND)


def _neighbours(min_words: int, inside: bool):
    """Compares the suffixes of a sorted range with their neighbours. Gives spans, and if ``inside`` a range also its
    first and last suffix and the windows of frequent keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, None
        spans: list[tuple] = []
        wins: list[tuple] = []

        def settle(s: Around) -> None:
            span = s.span()
            if span:
                spans.append(span)
            if inside and s.wins:
                wins.append((s, *s.windows(min_words)))

        def flush() -> Iterator[pd.DataFrame]:
            if spans:
                row, lo, hi = zip(*spans)
                yield _frame(0, len(row), row=row, **{"from": lo, "to": hi})
            if wins:
                n = [len(w[1]) for w in wins]
                each = {c: np.repeat([getattr(w[0], c) for w in wins], n) for c in ("key", "row", "place")}
                offs, known, hashes = (np.concatenate([w[i] for w in wins]) for i in (1, 2, 3))
                yield _frame(2, len(offs), low=offs, many=known, hash=hashes, **each)
            spans.clear()
            wins.clear()

        for pdf in batches:
            for lo in range(0, len(pdf), 2_000):
                for raw in zip(*(pdf[c].iloc[lo:lo + 2_000].tolist() for c in SUFFIX)):
                    new = Around(*raw)
                    if last is None:
                        first = new
                    else:
                        last.compare(new, min_words)
                        settle(last)
                    last = new
                yield from flush()
        if last is not None:
            settle(last)
            yield from flush()
            if inside:  # a range of one suffix has one end
                ends = [first.raw] if first is last else [first.raw, last.raw]
                yield _frame(1, len(ends), **dict(zip(SUFFIX, zip(*ends))))

    return run


def _window_words(min_words: int):
    """Rows ``key, words, row, start`` of windows (``offs``) of suffixes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, row, place, right, left, offs in zip(*(pdf[c] for c in ("key", "row", "place", "right", "left", "offs"))):
                right, left = right.split(), left.split()
                for o in offs:
                    rows.append((key, b" ".join([*left[:o][::-1], *right[:min_words - o]]), row, place - o))
            yield pd.DataFrame(rows, columns=["key", "words", "row", "start"])

    return run


def missed_by_neighbours(seen: DataFrame, suffixes: DataFrame, min_words: int) -> DataFrame:
    """Spans ``row, from, to`` of the windows in ``seen`` that no neighbour matched though another suffix of
    the key has the same words."""
    twins = written(seen.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("known"), 1)).alias("open"))
                    .filter("n > 1 and open > 0").select("key", "hash"), "suffix_twins")
    members = written(seen.join(twins, ["key", "hash"]), "suffix_members")
    asked = members.filter("not known").select("key", "row", "place", "off")
    stands = members.filter("known").groupBy("key", "hash").agg(
        F.min("row").alias("row"), F.min_by(F.col("place") * (1 << 8) + F.col("off"), "row").alias("at"))
    # one of the windows that a neighbour matched stands for all of them
    asked = asked.union(stands.select("key", "row", F.shiftright("at", 8).alias("place"), F.col("at").bitwiseAND(255).alias("off")))
    offs = asked.groupBy("row", "place").agg(F.collect_set("off").alias("offs"))
    texts = written(suffixes.select("key", "row", "place", "right", "left").join(offs, ["row", "place"]).mapInPandas(
        _window_words(min_words), "key long, words binary, row long, start long"), "suffix_windows")
    same = texts.groupBy("key", "words").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "words")
    return texts.join(same, ["key", "words"]).select("row", F.col("start").alias("from"), (F.col("start") + min_words).alias("to"))


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for row, found in zip(pdf["row"], pdf["found"]):
            mask = np.zeros(max(f["to"] for f in found), dtype=bool)
            for f in found:
                mask[f["from"]:f["to"]] = True
            rows.append((row, int(mask.sum()), [{"from": a, "to": b} for a, b in runs(mask)]))
        yield pd.DataFrame(rows, columns=["row", "n_repeated", "spans"])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
                      key_words: int = 25, gram: int = 8) -> DataFrame:
    """Per document: ``doc_id, n_words, n_repeated`` (words in passages of ``min_words`` words or more that also
    occur elsewhere) and ``spans`` (word ranges [from, to))."""
    if not gram <= key_words < min_words <= key_words + 255:
        raise ValueError("gram <= key_words < min_words <= key_words + 255")
    # Written with a row number: texts are joined with what is found in them, and ids may repeat.
    source = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                 F.sha2(F.col(text_col).cast("binary"), 256).alias("sha"),
                                 F.monotonically_increasing_id().alias("row")), "suffix_docs")
    # Exact copies need no search: one of them stands for all.
    classes = written(source.groupBy("sha").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")),
                      "suffix_classes")
    keys = written(source.select("row", "text").mapInPandas(
        _suffix_keys(min_words, key_words, gram), "row long, place long, key long").join(classes.select("row"), "row"),
        "suffix_keys")
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                     .select("key", (F.col("n") > 2).alias("many")), "suffix_shared")
    places = written(keys.join(shared, "key").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("place", "key", "many"))).alias("found")), "suffix_places")
    discard(keys)
    discard(shared)
    suffixes = written(source.select("row", "text").join(places, "row").mapInPandas(
        _cut_out(min_words, key_words, gram), SUFFIX_SCHEMA), "suffixes")
    discard(places)
    order = ["key", "right", "left", "row", "place"]
    found = written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _neighbours(min_words, True), FOUND_SCHEMA), "suffix_matches")
    # Two suffixes per range, whatever the size of the corpus: one task compares them in order.
    across = found.filter("kind = 1").select(*SUFFIX).coalesce(1).sortWithinPartitions(*order).mapInPandas(
        _neighbours(min_words, False), FOUND_SCHEMA)
    seen = found.filter("kind = 2").select("key", "hash", "row", "place", F.col("low").alias("off"), F.col("many").alias("known"))
    matched = (found.filter("kind = 0").union(across.filter("kind = 0")).select("row", "from", "to")
               .union(missed_by_neighbours(seen, suffixes, min_words)))
    spans = written(matched.groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("found"))
                    .mapInPandas(_spans, "row long, n_repeated long, spans array<struct<from: int, to: int>>"),
                    "suffix_spans")
    discard(found)
    discard(suffixes)
    classes = classes.join(spans, "row", "left").select("sha", "copies", "n_repeated", "spans")
    counted = source.mapInPandas(_count_words, f"id {source.schema['id'].dataType.simpleString()}, sha string, n_words long")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= min_words)
    span = F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to"))
    return counted.join(classes, counted["sha"].eqNullSafe(classes["sha"])).select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(whole, F.array(span)).otherwise(F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>")))
        .alias("spans"))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "sha": pdf["sha"], "n_words": [len(byte_words(t)) for t in pdf["text"]]})
