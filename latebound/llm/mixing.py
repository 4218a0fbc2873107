"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of words: the sources, ordered by code point
with null last, weigh ``weights`` in rotation and share ``share`` times all
words; no target exceeds ``cap`` times its source, and what is cut off is
shared by weight among the rest until none is above (water filling, solved in
closed form over the sorted cap/weight ratios).

The targets are dealt in equal blocks of ``block_tokens`` words. Seats go to
the highest quotients ``target / (2 k - 1)``: first to the sources, then, inside
each source, to groups of ``shard_group`` shards, then, inside each group, to its
shards of about ``shard_tokens`` words, so that each shard has an integer quota. A shard lays its documents end to end in an order given
by the seed; a quota of ``c`` rounds and ``r`` blocks takes every word ``c``
times and a run of ``r`` blocks once more, from a start given by the seed.

Only DataFrame operations run here. Document text never moves unless a caller
asks for it with ``keep``; a hot source is split into shards, so no window
sees more than about ``shard_tokens`` words of documents, or more than ``shard_group`` shards at once
(a source of 10**13 words has 10**8 shards in 10**5 groups).

Cases: a null text has size 0 and is taken 0 times; a null source is a source
of its own, ordered last; an empty table gives an empty table; repeated rows
and repeated ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import word_count


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``_src, _size`` (one row per source) plus ``_target`` and ``_at`` (its place in the order)."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_src").isNull(), F.col("_src"))
    w = (sources
         .withColumn("_at", F.row_number().over(order))
         .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)),
                                        ((F.col("_at") - 1) % len(weights) + 1).cast("int")).cast("double"))
         .withColumn("_cap", F.col("_size") * F.lit(float(cap)))
         .withColumn("_pool", F.sum("_size").over(everything) * F.lit(float(share))))
    # Sources reach their cap in the order of cap / weight. With the first ones
    # capped, each of the others gets level * weight; the level that holds is
    # that of the first source which stays below its cap.
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_pool") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    w = w.withColumn("_level", level)
    holds = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    w = w.withColumn("_final", F.max(holds).over(everything))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("_w")))
    return w.select("_src", "_size", "_at", target.alias("_target"))


def sainte_lague(parties: DataFrame, within: list[str], party: list[str], target: str, house: Column,
                 most: Column) -> DataFrame:
    """Seats per party: the ``house`` highest quotients target/(2k-1) within
    each group of ``within``, at most ``most`` for a party. Returns ``parties``
    with a column ``_seats``.

    Starting from rounded shares, only the seats near the last quotient are
    listed. A party's seats change by at most its share of (change + parties)
    plus one, so the listed seats number O(parties), not O(house).
    """
    group = Window.partitionBy(*within)
    share = F.coalesce(F.col(target) / F.nullif(F.sum(target).over(group), F.lit(0.0)), F.lit(0.0))
    p = (parties.withColumn("_house", house.cast("long")).withColumn("_most", most.cast("long"))
         .withColumn("_share", share)
         .withColumn("_base", F.least(F.floor(F.col("_share") * F.col("_house") + 0.5), F.col("_most")))
         .withColumn("_miss", F.col("_house") - F.sum("_base").over(group))
         .withColumn("_n", F.count(F.lit(1)).over(group)))
    steps = F.ceil(F.col("_share") * (F.abs("_miss") + F.col("_n"))) + 1
    seats = (p.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), steps)))
             .withColumn("_seat", F.when(F.col("_miss") > 0, F.col("_base") + F.col("_k"))
                         .otherwise(F.col("_base") - F.col("_k") + 1))
             .withColumn("_free", F.when(F.col("_miss") > 0, F.col("_seat") <= F.col("_most"))
                         .otherwise(F.col("_seat") >= 1)))
    quotient = F.col(target) / (2 * F.col("_seat") - 1)
    order = group.orderBy(F.desc("_free"), F.when(F.col("_miss") > 0, -quotient).otherwise(quotient), *party)
    change = F.when(F.col("_free") & (F.row_number().over(order) <= F.abs("_miss")), 1).otherwise(0)
    keys = list(dict.fromkeys([*within, *party]))
    return (seats.withColumn("_change", change)
            .groupBy(*keys, *[c for c in parties.columns if c not in keys], "_base", "_miss")
            .agg(F.sum("_change").alias("_changed"))
            .withColumn("_seats", F.col("_base") + F.signum("_miss").cast("long") * F.col("_changed"))
            .drop("_base", "_miss", "_changed"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                keep: tuple[str, ...] = (), weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                cap: float = 2.0, block_tokens: int = 16, shard_tokens: int = 100_000, shard_group: int = 1000,
                seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, the
    number of whole ``rounds`` and the word ``ranges`` [from, to) taken once
    more. ``keep`` names further input columns to carry along as ``keep_*``."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"),
                       word_count(F.col(text_col)).alias("_size"),
                       *[F.col(c).alias(f"keep_{c}") for c in keep])
    # Words are counted once, in one pass over the texts; with ``keep`` the last step makes another.
    sizes = materialize(base.select("_id", "_src", "_size"), "mix_sizes")
    # The small tables are written, so that Spark knows their sizes when it plans the joins with the documents.
    sources = sizes.groupBy("_src").agg(F.sum("_size").alias("_size"))
    sources = source_targets(sources, weights, share, cap)
    sources = materialize(sainte_lague(
        sources, [], ["_at"], "_target",
        F.round(F.sum("_target").over(Window.partitionBy()) / block_tokens),
        cap * F.ceil(F.col("_size") / block_tokens)), "mix_sources").withColumnRenamed("_size", "_source_size")

    n_shards = F.greatest(F.ceil(F.col("_source_size") / shard_tokens), F.lit(1))

    def place(rows: DataFrame) -> DataFrame:
        return (rows.join(sources, rows["_src"].eqNullSafe(sources["_src"])).drop(sources["_src"])
                .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), n_shards)))

    # Seats go to groups of shards first, so no window holds all shards of a source. Shares are whole numbers of
    # words, whose sums do not depend on the order of rows.
    shards = materialize(
        place(sizes).groupBy("_at", "_shard").agg(F.sum("_size").alias("_words"), F.first("_seats").alias("_quota"))
        .withColumn("_group", F.floor(F.col("_shard") / shard_group))
        .withColumn("_most", cap * F.ceil(F.col("_words") / block_tokens))
        .withColumn("_part", F.col("_words").cast("double")), "mix_parts")
    groups = shards.groupBy("_at", "_group").agg(F.sum("_part").alias("_part"), F.sum("_most").alias("_most"),
                                                 F.first("_quota").alias("_quota"))
    groups = materialize(
        sainte_lague(groups, ["_at"], ["_group"], "_part", F.col("_quota"), F.col("_most"))
        .select("_at", "_group", F.col("_seats").alias("_group_quota")), "mix_groups")
    shards = materialize(
        sainte_lague(shards.select("_at", "_group", "_shard", "_words", "_part", F.col("_most").alias("_limit"))
                     .join(groups, ["_at", "_group"]),
                     ["_at", "_group"], ["_shard"], "_part", F.col("_group_quota"), F.col("_limit"))
        .select("_at", "_shard", "_words", F.col("_seats").alias("_blocks")), "mix_shards")

    blocks = F.greatest(F.ceil(F.col("_words") / block_tokens), F.lit(1))
    more = F.col("_blocks") % blocks
    first = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_at"), F.col("_shard")), blocks)
    runs = shards.select(
        "_at", "_shard", F.floor(F.col("_blocks") / blocks).alias("_rounds"),
        (first * block_tokens).alias("_from"),
        F.least((first + more) * block_tokens, F.col("_words")).alias("_to"),
        (F.greatest(first + more - blocks, F.lit(0)) * block_tokens).alias("_wrap"))
    laid = Window.partitionBy("_at", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), F.col("_id")), "_id", "_size")
    laid_docs = (place(base if keep else sizes).withColumn("_end", F.sum("_size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("_start", F.col("_end") - F.col("_size")))

    def clip(lo: Column, hi: Column) -> Column:
        a, b = F.greatest(F.col("_start"), lo), F.least(F.col("_end"), hi)
        return F.struct((a - F.col("_start")).alias("from"), (b - F.col("_start")).alias("to"))

    both = F.array(clip(F.lit(0).cast("long"), F.col("_wrap")), clip(F.col("_from"), F.col("_to")))
    out = (laid_docs.join(runs, ["_at", "_shard"])
           .withColumn("_ranges", F.filter(both, lambda r: r["from"] < r["to"])))
    extra = F.aggregate("_ranges", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_src").alias("source"), F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_rounds") * F.col("_size") + extra).alias("taken"), F.col("_rounds").alias("rounds"),
        F.col("_ranges").alias("ranges"), *[F.col(f"keep_{c}") for c in keep])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: each whole round is
    one row with the text as it is; words taken once more are one row with
    these words joined by spaces. Documents taken 0 times go. ``n_chars``, if
    there, is recomputed."""
    cols = docs.columns
    m = mix_sources(docs, keep=tuple(cols), **options)
    words = F.filter(F.split(F.col("keep_text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # A run that wraps round may take two ranges of one document: the words stay in their order.
    part = F.array_join(F.flatten(F.transform(
        "ranges", lambda r: F.slice(words, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    whole = F.array_repeat(F.col("keep_text"), F.col("rounds").cast("int"))
    texts = F.concat(whole, F.when(F.size("ranges") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = m.filter(F.col("taken") > 0).withColumn("_text", F.explode(texts))
    return out.select(*[F.col("_text").alias(c) if c == "text" else
                        F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
                        F.col(f"keep_{c}").alias(c) for c in cols])
