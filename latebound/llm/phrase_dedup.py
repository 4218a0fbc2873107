"""Substring dedup by repeated-phrase automata.

A word goes if a window of ``window`` words that covers it also starts in a
document with a smaller id. The passages that recur are found and confirmed,
compiled into sharded Aho-Corasick automata, and documents are streamed
through the automata to locate every occurrence:

1. Of texts that several documents share, only the least id's is searched; all
   windows of the others start there too, so all their words go (if they have a window).
2. A window's value is the least hash of its ``gram``-word groups. Equal windows
   have equal values, and only about one of four groups is ever a least one.
   Values of two documents or more are kept, each with a shard: a hash of the
   least id that has it, so that neighbouring values of one passage mostly share a shard.
3. Every document is cut into stretches, runs of windows whose values have one
   shard. A window has one value, so it goes to one shard, and equal
   windows meet there.
4. Windows in the stretches of two documents or more are confirmed (by hash, partial
   sums first); the smallest id owns them. The owner's runs of confirmed windows are
   passages.
5. A shard's stretches are dealt into chunks of about ``chunk_bytes``, so a passage that a
   third of all documents share is located by many tasks. Each chunk compiles
   its shard's passages into an automaton. The patterns are the passages'
   blocks of ``block`` words, cut one after another; a window of at least
   2 * block - 1 words holds a whole block. The windows that hold a block found in a
   document are looked up, by their words, among the passages' windows with that block.

Matches compare words, not hashes; hashes only choose what to compare. Texts
are equal if 96 bits of hashes are.

Cases: a null, empty or short text has no window and keeps its words; a null
id is not smaller than any other, so such a document neither loses words nor
makes others lose any; equal ids make no difference to each other; repeated
rows get equal results; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import WordHasher, runs, sliding_min, windows
from .stages import discard, written
from .words import byte_words


def _values(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The value of every window, as longs."""
    return sliding_min(windows(hashes, gram), window - gram + 1).view(np.int64)


def _document_values(window: int, gram: int):
    """Rows ``value, id, tag``: each value of a document once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for pdf in batches:
            found = []
            for t in pdf["text"]:
                v = _values(hasher(byte_words(t)), window, gram)
                # Equal values mostly follow each other; what is left is sorted.
                found.append(np.unique(v[np.flatnonzero(np.diff(v, prepend=v[:1] - 1))]) if len(v) else v)
            n = [len(f) for f in found]
            yield pd.DataFrame({"value": np.concatenate(found) if found else np.empty(0, dtype=np.int64),
                                "id": pdf["id"].repeat(n).to_numpy(), "tag": pdf["tag"].repeat(n).to_numpy()})

    return run


def _stretches(window: int, gram: int):
    """Rows ``shard, id, own, first, words, wins``: runs of windows of one shard, with their words and hashes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for pdf in batches:
            rows = []
            for ident, own, text, known, of in zip(pdf["id"], pdf["own"], pdf["text"], pdf["vals"], pdf["shards"]):
                words = byte_words(text)
                h = hasher(words)
                v = _values(h, window, gram)
                at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                shard = np.where(known[at] == v, of[at], -1)
                if not len(shard) or shard.max() < 0:
                    continue
                wins = windows(h, window).view(np.int64)
                edges = np.flatnonzero(np.diff(shard)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
                    if shard[a] >= 0:
                        rows.append((int(shard[a]), ident, own, a, b" ".join(words[a:b + window - 1]), wins[a:b]))
            yield pd.DataFrame(rows, columns=["shard", "id", "own", "first", "words", "wins"])

    return run


def _passages(window: int):
    """Rows ``shard, owner, words``: runs of the windows (``offs``, places in a stretch) that the document owns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ident, shard, raw, offs in zip(pdf["id"], pdf["shard"], pdf["words"], pdf["offs"]):
                words = raw.split()
                mask = np.zeros(len(words), dtype=bool)
                mask[offs] = True
                rows += [(shard, ident, b" ".join(words[a:b + window - 1])) for a, b in runs(mask)]
            yield pd.DataFrame(rows, columns=["shard", "owner", "words"])

    return run


def _locate(passages: list[tuple[object, bytes]], docs: pd.DataFrame, window: int, block: int) -> pd.DataFrame:
    """Words of the stretches' documents covered by matches with passages of smaller owners, as runs [from, to)."""
    import ahocorasick

    if not passages:
        return pd.DataFrame(columns=["id", "own", "from", "to"])
    # A window holds a whole block of its passage, behind at most ``window - block`` of its words. Each block keeps, per
    # number of words before it, the passages' windows that hold it there, by their words, and their smallest owner. So a
    # block found costs as many lookups, however many versions of a text the passages have.
    lead = range(window - block + 1)
    around: dict[bytes, list[dict[bytes, object]]] = {}
    for owner, raw in passages:
        words = raw.split()
        for at in range(0, len(words) - block + 1, block):
            places = around.setdefault(b" ".join(words[at:at + block]), [{} for _ in lead])
            for o in lead:
                if o <= at and at - o + window <= len(words):
                    w = b" ".join(words[at - o:at - o + window])
                    if w not in places[o] or owner < places[o][w]:
                        places[o][w] = owner
    automaton = ahocorasick.Automaton()
    for key, places in around.items():
        automaton.add_word(" " + key.decode("latin-1") + " ", places)
    automaton.make_automaton()
    rows = []
    for ident, own_hash, first, raw in zip(docs["id"], docs["own"], docs["first"], docs["words"]):
        words = raw.split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        stops = np.cumsum([len(w) + 1 for w in words])  # place of the space after each word
        mask = np.zeros(len(words), dtype=bool)
        for stop, places in automaton.iter(line):
            start = int(np.searchsorted(stops, stop)) - block + 1
            for o in lead:
                if o <= start and start - o + window <= len(words):
                    owner = places[o].get(b" ".join(words[start - o:start - o + window]))
                    if owner is not None and owner < ident:
                        mask[start - o:start - o + window] = True
        for a, b in runs(mask):
            rows.append((ident, own_hash, first + a, first + b))
    return pd.DataFrame(rows, columns=["id", "own", "from", "to"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _kept(window: int):
    """Rows ``doc_id, n_words, n_removed, kept_sha256, kept_text`` of documents ``id, text, copy, found``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, copy, found in zip(pdf["text"], pdf["copy"], pdf["found"]):
                words, kept = byte_words(text), None
                if copy and len(words) >= window:
                    kept = []
                elif found is not None and len(found):
                    mask = np.ones(len(words), dtype=bool)
                    for r in found:
                        mask[r["from"]:r["to"]] = False
                    kept = [w for w, k in zip(words, mask.tolist()) if k]
                left = words if kept is None else kept
                rows.append((len(words), len(words) - len(left), _digest(left),
                             None if kept is None else b" ".join(kept).decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            out.insert(0, "doc_id", pdf["id"].to_numpy())
            yield out

    return run


def repeated_phrases(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                     gram: int = 7, block: int = 7, shard_values: int = 20_000,
                     chunk_bytes: int = 16_000_000) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256`` and
    ``kept_text`` (the kept words; null where none was removed)."""
    if not gram < window or window < 2 * block - 1:
        raise ValueError("a window must hold a whole block and several groups")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "*", F.xxhash64("text").alias("own"), F.hash("text").alias("own2"))
    kind = source.schema["id"].dataType.simpleString()
    copies = written(source.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).groupBy("own", "own2").agg(
        F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("own", "own2", "least"), "phrase_copies")
    marked = source.join(copies, ["own", "own2"], "left").select(
        "id", "text", "own", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copy"))
    # Ids may repeat; a few bits of the text tell most such rows apart while their values travel.
    searched = marked.filter(F.col("id").isNotNull() & ~F.col("copy")).select(
        "id", "text", "own", F.pmod("own", F.lit(1024)).cast("short").alias("tag"))

    values = written(searched.select("id", "tag", "text").mapInPandas(
        _document_values(window, gram), f"value long, id {kind}, tag short"), "phrase_values")
    shared = written(values.groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
                     .select("value", F.xxhash64("a").alias("place")), "phrase_shared")
    shards = max(1, math.ceil(shared.count() / shard_values))
    routes = written(values.join(shared, "value").groupBy("id", "tag").agg(F.sort_array(F.collect_set(
        F.struct("value", F.pmod("place", F.lit(shards)).cast("int").alias("shard")))).alias("r"))
        .select("id", "tag", F.col("r.value").alias("vals"), F.col("r.shard").alias("shards")), "phrase_routes")
    discard(values)
    discard(shared)
    # A repeated row has its stretches once.
    stretches = written(searched.join(routes, ["id", "tag"]).mapInPandas(
        _stretches(window, gram), f"shard int, id {kind}, own long, first int, words binary, wins array<long>")
        .dropDuplicates(["shard", "id", "own", "first"]), "phrase_stretches")
    discard(routes)

    # A window's owner, and one place of it there: the stretch's first word and the window's number in it.
    seen = stretches.select("shard", "id", "first", F.posexplode("wins").alias("off", "w"))
    confirmed = seen.groupBy("shard", "w").agg(
        F.min("id").alias("a"), F.max("id").alias("b"),
        F.min_by(F.shiftleft(F.col("first").cast("long"), 31) + F.col("off"), "id").alias("place")).filter("a < b")
    owned = confirmed.groupBy("shard", F.col("a").alias("id"), F.shiftright("place", 31).cast("int").alias("first")).agg(
        F.collect_list(F.col("place").bitwiseAND((1 << 31) - 1).cast("int")).alias("offs"))
    passages = written(stretches.select("shard", "id", "first", "words", F.size("wins").alias("n"))
                       .join(owned, ["shard", "id", "first"])
                       .withColumn("offs", F.filter("offs", lambda o: o < F.col("n"))).mapInPandas(
        _passages(window), f"shard int, owner {kind}, words binary"), "phrase_passages")
    chunks = stretches.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words")) / chunk_bytes).alias("chunks"))
    left = passages.join(chunks, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "owner", "words")
    right = stretches.join(chunks, "shard").select(
        "shard", F.pmod(F.xxhash64("id", "own", "first"), "chunks").alias("chunk"), "id", "own", "first", "words")

    def locate(known: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        return _locate(list(dict.fromkeys(zip(known["owner"], known["words"]))), texts, window, block)

    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(
        locate, f"id {kind}, own long, from int, to int")
    found = written(found.groupBy("id", "own").agg(F.collect_list(F.struct("from", "to")).alias("found")), "phrase_found")
    discard(stretches)
    discard(passages)
    return marked.join(found, ["id", "own"], "left").select("id", "text", "copy", "found").mapInPandas(
        _kept(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
