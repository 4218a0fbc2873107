"""Toxicity by noisy-channel deobfuscation.

Who hides an insult writes it with look-alike signs (1d!0t), letters apart
(i d i o t, i.d.i.o.t), letters repeated (idiooot) or starred out (id*ot). Such text is
restored before it is scored:

1. Language model: 4-character counts over the words of all documents, added
   up in every task (28 symbols, so at most 28^4 counts whatever the corpus) and
   summed by one aggregate. Shorter contexts smooth longer ones.
2. Channel: a token with signs of disguise becomes a lattice. A look-alike gives
   its letters, a star any vowel, a separator a word boundary or nothing, a run of three or
   more equal letters one or two of them; each way has a cost. Runs of three or more tokens of one
   character are one lattice with the blanks as separators.
3. Viterbi decoding finds the path of least channel cost minus log probability;
   its states are the last three symbols. It is exact and linear in the token.
   Tokens without such signs are only lower-cased and lose accents.
4. Score: logistic regression on the restored words of labelled documents. The
   ``vocabulary`` words that tell the classes apart best (likelihood ratio) are
   features: present or not, so long texts weigh no more than short ones.

Bounds: the classifier and its words are fitted on about ``train_rows`` labelled documents, drawn
by hash of their id, and documents with equal texts count once. The language model
and the scores cover all documents and whole texts.

Cases: a null or empty text has no words and gets the intercept's score; very
long texts are read whole; documents with equal texts get equal scores; a null
id is not held out and has no label; labels that are null, of unknown ids or contradict each
other (mean 0.5) are not used; with no label, or none of one class, the score is the share of
toxic ones (0 without any); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import written

#: Symbols: 0 is a boundary, 1 to 26 are a to z, 27 is any other letter.
SYMBOLS = 28
ORDER = 4
OTHER = 27

#: Letters that a sign may stand for (fixed values, parameter of the channel).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
WILD = {"*": "aeiou", "#": "aeiou"}
SEPARATORS = set(".-_/~'’ ")

#: Channel costs, in nats.
COST_LOOKALIKE, COST_WILD, COST_DROP, COST_BREAK, COST_ONE, COST_TWO = 0.7, 1.6, 1.0, 1.0, 0.2, 0.7

#: Tokens remembered by a task; beyond it the memory starts anew.
MEMORY = 400_000

_EDGE = ".,;:?\"'’`)]}>…»«“”„"
_FRONT = _EDGE + "([{<"
_TAIL = re.compile(r"[^\w\s]{3,}$|!+$")
_HEAD = re.compile(r"^[^\w\s]{3,}")
_SIGNS = re.compile(r"[0-9@$!|+(€£*#]")
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"^[^\W_](?:[.\-_/~*][^\W_]){2,}$")
_SPACED = re.compile(r"(?<!\S)(?:[\w@$!+*]\s+){2,}[\w@$!+*](?!\S)")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return OTHER if c.isalpha() else 0


def _letter_table() -> np.ndarray:
    """Symbols of the code points below U+0250; the last entry is that of all others."""
    out = [symbol((fold(chr(i)) or " ")[0]) for i in range(0x250)]
    return np.array([*out, OTHER], dtype=np.int64)


def gram_codes(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Codes of all 4-symbol groups of the texts' words, each word with three boundaries before and one behind."""
    joined = " " + " ".join(texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sym = table[np.minimum(raw, len(table) - 1)]
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    sym = sym[keep]
    sym = np.repeat(sym, np.where(sym == 0, ORDER - 1, 1))
    n = len(sym) - ORDER + 1
    code = np.zeros(n, dtype=np.int64)
    for j in range(ORDER):
        code = code * SYMBOLS + sym[j:j + n]
    return code[(sym[ORDER - 1:] != 0) | (sym[ORDER - 2:-1] != 0)]


#: Characters that are counted together.
PART = 4_000_000


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table, counts = _letter_table(), np.zeros(SYMBOLS ** ORDER, dtype=np.int64)

    def add(texts: list[str]) -> None:
        codes, n = np.unique(gram_codes(texts, table), return_counts=True)
        counts[codes] += n

    for pdf in batches:
        held, size = [], 0
        for t in pdf["text"]:
            if t:
                held.append(t)
                size += len(t)
            if size > PART:
                add(held)
                held, size = [], 0
        if held:
            add(held)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"code": at.astype(np.int32), "n": counts[at]})


def smoothed(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Log probability of every group's last symbol after its first three."""
    c = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for used in range(1, ORDER + 1):  # contexts of 0, 1, 2, 3 symbols
        n = c.sum(axis=tuple(range(ORDER - used)))
        p = (n + strength * p) / (n.sum(axis=-1, keepdims=True) + strength)
    return np.log(p).reshape(-1).astype(np.float32)


def language_model(texts: DataFrame) -> np.ndarray:
    """The model of a table with a column ``text``; 28^4 numbers."""
    rows = texts.mapInPandas(_count_grams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS ** ORDER, dtype=np.int64)
    counts[rows["code"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return smoothed(counts)


def lattice(chars: str) -> list[list[tuple[tuple[int, ...], float]]]:
    """For each run of equal characters its ways to be read: symbols and cost."""
    out = []
    for run in re.finditer(r"(.)\1*", chars, re.S):
        c, n = run.group(1), len(run.group(0))
        s = symbol(c)
        ways: list[tuple[tuple[int, ...], float]] = []
        if s:
            ways = [((s,) * n, 0.0)] if n < 3 else [((s,), COST_ONE), ((s, s), COST_TWO)]
        letters, cost = (LOOKALIKES[c], COST_LOOKALIKE) if c in LOOKALIKES else (WILD.get(c, ""), COST_WILD)
        for x in letters:
            ways += [((symbol(x),) * m, cost * m) for m in sorted({1, min(n, 2)})]
        if not s:  # a separator, or a sign that says nothing
            ways += [((0,), COST_BREAK if c not in SEPARATORS else COST_BREAK / 2), ((), COST_DROP)]
        out.append(ways)
    return out


def decode(chars: str, model: np.ndarray) -> list[str]:
    """The words of the best path through the lattice of a folded token."""
    size = SYMBOLS ** (ORDER - 1)
    # States are the last three symbols of a word; boundaries in a row count as one. Each keeps cost and a linked path.
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for ways in [*lattice(chars), [((0,), 0.0)]]:
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for symbols, extra in ways:
                at, total, line = state, cost + extra, path
                for s in symbols:
                    if s or at:
                        total -= float(model[at * SYMBOLS + s])
                        at, line = (at * SYMBOLS + s) % size if s else 0, (s, line)
                if at not in new or total < new[at][0]:
                    new[at] = (total, line)
        best = new
    _, path = min(best.values(), key=lambda v: v[0])
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    text = "".join(" " if s == 0 else "?" if s == OTHER else chr(96 + s) for s in reversed(out))
    return text.split()


class Restorer:
    """Restored words of texts; remembers tokens while the memory lasts."""

    def __init__(self, model: np.ndarray):
        self.model, self.seen = model, {}

    def token(self, t: str) -> tuple[str, ...]:
        """Restored words of a token."""
        got = self.seen.get(t)
        if got is None:
            got = self._restore(t)
            if len(self.seen) > MEMORY:
                self.seen = {}
            if len(t) <= 64:
                self.seen[t] = got
        return got

    def _restore(self, t: str) -> tuple[str, ...]:
        if t.isalpha() and t.isascii() and not _REPEAT.search(t):
            return (t.lower(),)
        core = _HEAD.sub("", _TAIL.sub("", t.rstrip(_EDGE)).rstrip(_EDGE)).lstrip(_FRONT)
        core = fold(core)
        if any(c.isalpha() for c in core) and (
                (_SIGNS.search(core) and len(core) > 1) or _REPEAT.search(core) or _APART.match(core)):
            return tuple(decode(core, self.model))
        return tuple(_LETTERS.findall(core))

    def runs(self, text: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """Stretches of letters apart: start, end and restored words."""
        out = []
        for m in _SPACED.finditer(text):
            chars = fold(" ".join(m.group().split()))
            if sum(c.isalpha() for c in chars) >= 2:
                out.append((m.start(), m.end(), tuple(decode(chars, self.model))))
        return out

    def words(self, text: str | None) -> set[str]:
        """Different restored words of a text."""
        if not text:
            return set()
        out: set[str] = set()
        for t in set(text.split()):
            out.update(self.token(t))
        for _, _, found in self.runs(text):
            out.update(found)
        return out

    def text(self, text: str | None) -> str | None:
        """The text with its disguised tokens restored; the others stay as they are."""
        if not text:
            return text

        def plain(part: str) -> str:
            def one(m: re.Match) -> str:
                words = " ".join(self.token(m.group()))
                same = " ".join(_LETTERS.findall(fold(m.group())))
                return m.group() if words == same else words

            return re.sub(r"\S+", one, part)

        out, at = [], 0
        for a, b, words in self.runs(text):
            out += [plain(text[at:a]), " ".join(words)]
            at = b
        return "".join([*out, plain(text[at:])])


def remainder(ident: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(5))


def training_words(docs: DataFrame, labels: DataFrame, model, train_rows: int) -> DataFrame:
    """Written rows ``right`` (0 or 1) and ``words`` of a bounded sample of labelled documents that are not held out."""
    known = (labels.filter((remainder(F.col("id")) != 0) & F.col("toxic").isNotNull())
             .groupBy("id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic")))
    n = known.count()
    part = int(min(1.0, train_rows / max(1, n)) * (1 << 20))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part)
    texts = (docs.join(drawn, "id").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
             .groupBy("sha").agg(F.avg("toxic").alias("toxic"), F.first("text").alias("text"))
             .filter("toxic != 0.5"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model.value)
        for pdf in batches:
            yield pd.DataFrame({"right": (pdf["toxic"] > 0.5).astype(float),
                                "words": [sorted(restorer.words(t)) for t in pdf["text"]]})

    return written(texts.select("toxic", "text").mapInPandas(run, "right double, words array<string>"), "toxic_train")


def telling_words(train: DataFrame, vocabulary: int, least: int) -> list[str]:
    """The words of at least ``least`` documents with the greatest likelihood ratio between the classes."""
    n = train.agg(F.count(F.lit(1)), F.sum("right")).first()
    total, ones = float(n[0] or 0), float(n[1] or 0)
    if not 0 < ones < total:
        return []
    seen = train.select("right", F.explode("words").alias("word")).filter(F.length("word") <= 40).groupBy("word").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("right").alias("k")).filter(F.col("n") >= least)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    k, m = F.col("k"), F.col("n")
    ratio = (part(k, m * ones / total) + part(m - k, m * (total - ones) / total)
             + part(F.lit(ones) - k, (total - m) * ones / total)
             + part(F.lit(total - ones) - (m - k), (total - m) * (total - ones) / total))
    top = seen.select("word", ratio.alias("ratio")).orderBy(F.desc("ratio"), "word").limit(vocabulary)
    return [r["word"] for r in top.collect()]


def fit_weights(train: DataFrame, words: list[str], penalty: float) -> tuple[dict[str, float], float]:
    """Weight per word, and the intercept."""
    if not words:
        share = train.agg(F.avg("right")).first()[0]
        share = 0.0 if share is None else min(1.0, max(0.0, share))
        return {}, (-50.0 if share == 0 else 50.0 if share == 1 else math.log(share / (1 - share)))
    spark = train.sparkSession
    vectors = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    frame = vectors.transform(train).select("features", "right").coalesce(max(1, spark.sparkContext.defaultParallelism))
    fitted = LogisticRegression(featuresCol="features", labelCol="right", regParam=penalty, elasticNetParam=0.5,
                                maxIter=60, standardization=False).fit(frame)
    weights = fitted.coefficients.toArray()
    return {w: float(x) for w, x in zip(words, weights) if x}, float(fitted.intercept)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    label_id: str = "doc_id", label_col: str = "toxic", train_rows: int = 20_000,
                    vocabulary: int = 2_048, least: int = 5, penalty: float = 0.0005,
                    with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``, ``evidence`` (its words that speak for toxicity, the
    strongest first) and, if asked for, ``restored`` (the text without disguise)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(language_model(source.select("text")))
    train = training_words(source, labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("toxic")), model,
                           train_rows)
    weights, intercept = fit_weights(train, telling_words(train, vocabulary, least), penalty)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model.value)
        for pdf in batches:
            scores, evidence = [], []
            for t in pdf["text"]:
                found = sorted((w for w in restorer.words(t) if w in weights), key=lambda w: (-weights[w], w))
                z = intercept + math.fsum(weights[w] for w in found)
                scores.append(1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z)))
                evidence.append([w for w in found if weights[w] > 0])
            out = pd.DataFrame({"doc_id": pdf["id"], "score": scores, "evidence": evidence})
            if with_text:
                out["restored"] = [restorer.text(t) for t in pdf["text"]]
            yield out

    found = source.mapInPandas(run, f"doc_id {kind}, score double, evidence array<string>"
                               + ", restored string" * with_text)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
                        *["restored"] * with_text)
