"""A3: city cleansing against a lookup, exact and for misspelled names; A4: regional bottlenecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.city import city_key
from ..functions.rates import count_true, ratio
from ..schema import CITIES, validate
from .facts import CARRIER, SELLER


def _lookup(cities: DataFrame) -> DataFrame:
    """One row per (key, state): a lookup with duplicate keys would
    multiply the rows it is joined to."""
    validate(cities, CITIES, "cities")
    return (cities.groupBy("city_key", "state")
            .agg(F.min("city").alias("city"))
            .where(F.col("city_key").isNotNull()))


def _keys(df: DataFrame, raw_col: str, state_col: str | None) -> DataFrame:
    """``_full``: the key of the whole text; ``_short``: without the state's name at its end."""
    full = city_key(F.col(raw_col))
    short = full if state_col is None else city_key(F.col(raw_col), F.col(state_col))
    return df.withColumns({"_full": full, "_short": short})


def city_cleanse(df: DataFrame, cities: DataFrame, raw_col: str = "city_raw",
                 state_col: str | None = "state") -> DataFrame:
    """Add ``city_key`` (normalised ``raw_col``) and ``city`` (the clean
    name from ``cities``, NULL when unmatched). The whole text is looked up
    first; only if no city has that key, the text without the state's name at
    its end ("lages - sc", but "cidade de goias" in goias stays whole). Rows
    are never dropped nor repeated: without a state column, a name that
    several states have is ambiguous and gets no city.

    The lookup is small (one row per city) and AQE broadcasts it when its
    runtime size is under the broadcast threshold; otherwise it is an
    ordinary sort-merge join.
    """
    keyed = _keys(df, raw_col, state_col)
    look = _lookup(cities)
    if state_col is None:
        named = look.groupBy("city_key").agg(F.when(F.count(F.lit(1)) == 1, F.min("city")).alias("city"))
        return keyed.withColumnRenamed("_full", "city_key").drop("_short").join(named, "city_key", "left").select(
            *df.columns, "city_key", "city")
    whole = look.select(F.col("city_key").alias("_k1"), F.col("state").alias("_s1"), F.col("city").alias("_c1"))
    cut = look.select(F.col("city_key").alias("_k2"), F.col("state").alias("_s2"), F.col("city").alias("_c2"))
    state = F.col(state_col)
    first = keyed.join(whole, (F.col("_full") == F.col("_k1")) & (state == F.col("_s1")), "left")
    rest = F.when(F.col("_c1").isNull() & (F.col("_short") != F.col("_full")), F.col("_short"))
    both = first.withColumn("_rest", rest).join(cut, (F.col("_rest") == F.col("_k2")) & (state == F.col("_s2")), "left")
    return both.select(*df.columns,
                       F.when(F.col("_c1").isNotNull(), F.col("_full")).otherwise(F.col("_short")).alias("city_key"),
                       F.coalesce("_c1", "_c2").alias("city"))


def unmatched_cities(df: DataFrame, cities: DataFrame, raw_col: str = "city_raw",
                     state_col: str | None = "state") -> DataFrame:
    """Raw city values that find no clean city, with how many rows hold
    them (``rows``). NULL and empty keys are reported too."""
    keyed = _keys(df, raw_col, state_col)
    look = _lookup(cities)
    by_state = [] if state_col is None else [F.col("state").alias(state_col)]
    missing = keyed
    for key in ("_full", "_short"):
        names = look.select(F.col("city_key").alias(key), *by_state).distinct()
        missing = missing.join(names, names.columns, "left_anti")
    group = [raw_col, "city_key"] + ([state_col] if state_col else [])
    return missing.withColumnRenamed("_short", "city_key").groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))


def deletions(key: Column, depth: Column) -> Column:
    """``key`` itself and what is left of it after up to ``depth`` (1 or 2) letters are deleted."""
    def without_one(k: Column) -> Column:
        return F.when(F.length(k) > 0, F.transform(
            F.sequence(F.lit(1), F.length(k)),
            lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
        ).otherwise(F.array().cast("array<string>"))

    once = without_one(key)
    twice = F.flatten(F.transform(once, without_one))
    return F.array_distinct(F.concat(F.array(key), F.when(depth >= 1, once).otherwise(F.array().cast("array<string>")),
                                     F.when(depth >= 2, twice).otherwise(F.array().cast("array<string>"))))


def spelling_distance(length: Column, max_distance: int = 2) -> Column:
    """Typing errors allowed in a key: none below 3 letters, one below 6, else two; ``max_distance`` at most."""
    return F.least(F.lit(max_distance), F.when(length >= 6, 2).when(length >= 3, 1).otherwise(0))


def city_matched_fuzzy(df: DataFrame, cities: DataFrame, raw_col: str = "city_raw", state_col: str = "state",
                       max_distance: int = 2) -> DataFrame:
    """:func:`city_cleanse`, and misspelled names repaired from the lookup of
    their state: adds ``distance`` (0: found as it is; NULL: not found) and
    ``candidates`` (cities at the least distance). A name that two cities
    are equally near to keeps ``city`` NULL.

    Two keys at Levenshtein distance d have a string in common after at most
    d deletions in each. So each unmatched key (once, however many rows hold
    it) and each key of the lookup is filed under its deletions, an equi-join
    on (state, deletion) proposes pairs, and ``levenshtein`` decides. No
    unmatched key meets all cities.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError(f"max_distance must be 0, 1 or 2, not {max_distance!r}")
    base = city_cleanse(df, cities, raw_col, state_col)
    look = _lookup(cities).select(F.col("city_key").alias("_name"), F.col("state").alias("_state"),
                                  F.col("city").alias("_city"))
    missing = (base.where(F.col("city").isNull() & F.col("city_key").isNotNull())
               .select(F.col("city_key").alias("_key"), F.col(state_col).alias("_state")).distinct())
    filed = lambda t, k: t.withColumn(
        "_part", F.explode(deletions(F.col(k), spelling_distance(F.length(k), max_distance))))
    pairs = (filed(missing, "_key").join(filed(look, "_name"), ["_state", "_part"])
             .select("_key", "_state", "_name", "_city").distinct()
             .withColumn("_d", F.levenshtein("_key", "_name"))
             .where(F.col("_d") <= spelling_distance(F.least(F.length("_key"), F.length("_name")), max_distance)))
    near = pairs.groupBy("_key", "_state", "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("_city").alias("_city"))
    best = near.groupBy("_key", "_state").agg(F.min("_d").alias("_d"), F.min_by("_n", "_d").alias("_n"),
                                              F.min_by("_city", "_d").alias("_city"))
    joined = base.join(best.withColumnRenamed("_state", "_s"),
                       F.col("city").isNull() & (F.col("city_key") == F.col("_key"))
                       & (F.col(state_col) == F.col("_s")), "left")
    exact = F.col("city").isNotNull()
    return joined.select(
        *df.columns, "city_key",
        F.coalesce(F.col("city"), F.when(F.col("_n") == 1, F.col("_city"))).alias("city"),
        F.when(exact, F.lit(0)).otherwise(F.col("_d")).cast("int").alias("distance"),
        F.when(exact, F.lit(1)).otherwise(F.coalesce(F.col("_n"), F.lit(0))).cast("long").alias("candidates"))


def regional_bottlenecks(attributed: DataFrame, parties: DataFrame, cities: DataFrame,
                         role: str = "seller", level: str = "city", max_distance: int = 0) -> DataFrame:
    """Seller-caused and carrier-caused late rates per region.

    ``role`` picks whose location counts (``seller`` or ``customer``);
    ``parties`` is the matching dimension (``sellers`` / ``customers``).
    ``level`` is ``state``, ``city`` or ``rollup`` (state, city, total rows
    with ``level_id`` = grouping id: 0 city, 1 state, 3 total). With
    ``max_distance`` 1 or 2, misspelled city names count for their city
    (:func:`city_matched_fuzzy`).

    The line fact is first reduced to one row per party (partial
    aggregation absorbs a hot seller), and only that is joined to the
    located parties; the fact itself is never shuffled for the join.
    """
    key = {"seller": "seller_id", "customer": "customer_id"}[role]
    per_party = (attributed.groupBy(key)
                 .agg(F.count("late").alias("delivered"),
                      count_true(F.col("late") == 1).alias("late"),
                      count_true(F.col("cause") == SELLER).alias("seller_late"),
                      count_true(F.col("cause") == CARRIER).alias("carrier_late")))
    places = parties.select(key, "city_raw", "state")
    located = city_matched_fuzzy(places, cities, max_distance=max_distance) if max_distance else city_cleanse(places, cities)
    joined = per_party.join(located.select(key, "state", "city"), key, "left")
    aggs = [F.sum("delivered").cast("long").alias("delivered_lines"),
            F.sum("late").cast("long").alias("late_lines"),
            F.sum("seller_late").cast("long").alias("seller_late"),
            F.sum("carrier_late").cast("long").alias("carrier_late")]
    if level == "state":
        out = joined.groupBy("state").agg(*aggs)
    elif level == "city":
        out = joined.groupBy("state", "city").agg(*aggs)
    elif level == "rollup":
        out = joined.rollup("state", "city").agg(*aggs, F.grouping_id().cast("int").alias("level_id"))
    else:
        raise ValueError(f"level must be state, city or rollup, not {level!r}")
    sl, cl = F.col("seller_late"), F.col("carrier_late")
    return out.withColumns({
        "late_rate": ratio("late_lines", "delivered_lines"),
        "seller_rate": ratio("seller_late", "delivered_lines"),
        "carrier_rate": ratio("carrier_late", "delivered_lines"),
        "bottleneck": (F.when(F.col("late_lines") == 0, F.lit("none"))
                       .when(sl > cl, F.lit("seller"))
                       .when(cl > sl, F.lit("carrier"))
                       .otherwise(F.lit("tie"))),
    })
