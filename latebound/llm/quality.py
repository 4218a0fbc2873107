"""Quality rules: a table of thresholds compiled into Spark projections.

``RULES`` is plain data: a name, a ratio as a SQL expression over the counts
below, and the least and greatest value that passes. ``quality_counts`` derives
the counts of a text with built-in functions only, ``compile_rules`` turns the
table into one projection with a boolean column per rule and the verdict. There
is no shuffle, no join and no user function; each document is judged by its own
whole text.

Counts: ``n_words``; ``word_chars`` (code points in words); ``n_symbols``;
``n_lines`` (lines with a word); ``n_dup_lines`` (equal to an earlier one);
``n_repeat_words`` (words in 8-word windows that occur twice or more in the
text); ``n_stop_words`` (null where the document's language has no list, so that its
ratio is null and passes: prose of other languages is not judged by these words). Windows are compared by a 64-bit hash of their words'
hashes: within one text of n words the chance of a false repeat is below
n * n / 2^65.

Cases: null and empty texts have no words and fail the base rule; ratios whose
denominator is 0 are null and pass; very long texts are counted whole; repeated
rows are judged alike; an empty table gives an empty table; columns of the
input are carried along and win over nothing (result names that clash are
replaced by the result; without a language column no list applies).

The counts depend on a row number that the result drops. Spark moves filters below
projections by writing their expressions out, here whole arrays once per element;
it does not move them below a projection that numbers rows. So the result can be
filtered, counted and joined like any other; filter input columns before.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import words

#: Function words of prose by language code (fixed values, parameter ``stop_words``).
STOP_WORDS = {
    "en": "the of and to in is that it for on was as with be by this from are at an or a".split(),
    "de": "der die das und den von zu mit ist ein eine nicht auf für im dem des er es sie in an".split(),
    "fr": "le la les de du des et en un une que qui dans pour sur par est pas au avec il elle".split(),
    "es": "el la los las de y en un una que es del se por con para su lo como más al".split(),
}

#: Symbols that count as such.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    """``least <= ratio <= most``; a bound of None is not checked."""

    name: str
    ratio: str
    least: float | None
    most: float | None


#: The table. Ratios are SQL expressions over the counts.
RULES = (
    Rule("mean_word_chars", "word_chars / nullif(n_words, 0)", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.2),
    Rule("dup_line_share", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
    Rule("words_per_line", "n_words / nullif(n_lines, 0)", 2.0, None),
    Rule("stop_word_share", "n_stop_words / nullif(n_words, 0)", 0.03, 0.8),
)


def language(code: Column) -> Column:
    """The language of a code such as ``en``, ``EN`` or ``en-GB``."""
    return F.lower(F.regexp_extract(code.cast("string"), "^[A-Za-z]+", 0))


def quality_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``docs`` plus the counts. The steps are separate projections because
    each uses an array several times; Spark runs them in one stage."""
    cols = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(cols))])  # so that no name of the input clashes with those below
    text = F.coalesce(F.col(f"c{cols.index(text_col)}"), F.lit(""))
    arrays = own.select(
        "*", text.alias("_text"),
        words(text).alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    hashed = (arrays
              .withColumn("_n", F.size("_words"))
              .withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))))
    last = F.col("_n") - WINDOW
    window_hash = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WINDOW)]))
    hashed = hashed.withColumn("_w", F.when(last >= 1, window_hash))
    # Most texts repeat no window: only the others are sorted, as (hash, place) pairs.
    repeats = F.size(F.array_distinct("_w")) < F.size("_w")
    hashed = hashed.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform(
        "_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, j: F.get(F.col("_pairs"), j)["h"] == p["h"]
    places = F.sort_array(F.transform(F.filter(
        "_pairs", lambda p, j: F.coalesce(same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False))),
        lambda p: p["i"]))
    hashed = hashed.withColumn("_places", places)
    covered = F.aggregate(
        F.transform("_places", lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), j + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    plain = F.split(F.lower("_text"), r"[\x20\x09-\x0D.,;:!?]+")
    n_stop = F.lit(None).cast("long")
    if lang_col in cols:
        lang = language(F.col(f"c{cols.index(lang_col)}"))
        for code, listed in stop_words.items():
            n_stop = F.when(lang == code, F.size(F.filter(plain, lambda w: w.isin(list(listed)))).cast("long")).otherwise(n_stop)
    counts = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "n_symbols": F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_stop_words": n_stop,
    }
    numbered = hashed.select(*[F.col(f"c{i}") for i in range(len(cols))], *[c.alias(name) for name, c in counts.items()],
                             F.monotonically_increasing_id().alias("_row"))
    return numbered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols) if c not in counts],
                           *[F.when(F.col("_row") >= 0, F.col(name)).alias(name) for name in counts])


def passing_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    cols = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])  # keeps columns named like results
    named = {f"{k}_col": f"c{cols.index(k)}" for k in ("text", "lang") if k in cols}
    return quality_rules(plain, **named, **options).filter("kept").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[list[Column], Column]:
    """A boolean column per rule (null ratios pass), and their conjunction."""
    passes = []
    for r in rules:
        ratio = F.expr(r.ratio)
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & F.coalesce(ratio >= r.least, F.lit(True))
        if r.most is not None:
            ok = ok & F.coalesce(ratio <= r.most, F.lit(True))
        passes.append((r.name, ok))
    verdict = F.lit(True)
    for _, ok in passes:
        verdict = verdict & ok
    return [ok.alias(f"ok_{name}") for name, ok in passes], verdict


def quality_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
                  rules: tuple[Rule, ...] = RULES, stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``docs`` plus the counts, ``ok_<rule>``, ``base_failed`` (fewer than 20
    words, or over 30 % of words in repeated windows) and ``kept``."""
    counted = quality_counts(docs, text_col, lang_col, stop_words)
    flags, verdict = compile_rules(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = {f"ok_{r.name}" for r in rules} | {"base_failed", "kept"}
    return counted.select(*[F.col(c) for c in counted.columns if c not in names], *flags,
                          base.alias("base_failed"), (~base & verdict).alias("kept"))
