"""City names: the state's name at their end, and typing errors."""

import random

import pytest

from latebound import operators as op
from latebound.operators.regions import deletions, spelling_distance
from pyspark.sql import functions as F

CITIES = "city_key string, city string, state string"
SELLERS = "seller_id {}, city_raw string, state string"


def cities(spark, names, state="Goias"):
    from latebound.functions import city_key

    df = spark.createDataFrame([(n, state) for n in names], "city string, state string")
    return df.select(city_key("city").alias("city_key"), "city", "state")


def sellers(spark, raws, state="Goias"):
    return spark.createDataFrame([(i, r, state) for i, r in enumerate(raws)], SELLERS.format("int"))


def test_a_city_that_ends_in_its_states_name(spark):
    look = cities(spark, ["Cidade de Goias", "Lages"])
    got = {r["city_raw"]: (r["city_key"], r["city"]) for r in op.city_cleanse(sellers(
        spark, ["Cidade de Goiás", "cidade de goias - Goias", "Lages - Goias", "LAGES", "Porto Goias", None]), look).collect()}
    assert got == {"Cidade de Goiás": ("cidade de goias", "Cidade de Goias"),
                   "cidade de goias - Goias": ("cidade de goias", "Cidade de Goias"),
                   "Lages - Goias": ("lages", "Lages"), "LAGES": ("lages", "Lages"), "Porto Goias": ("porto", None),
                   None: (None, None)}
    left = {r["city_raw"] for r in op.unmatched_cities(sellers(spark, list(got)), look).collect()}
    assert left == {"Porto Goias", None}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(raw, names, most=2):
    """City, distance and candidates by comparing with every name."""
    if raw in names:
        return raw, 0, 1
    allowed = lambda n: min(most, 2 if n >= 6 else 1 if n >= 3 else 0)
    near = [(levenshtein(raw, n), n) for n in names]
    near = [(d, n) for d, n in near if d <= allowed(min(len(raw), len(n)))]
    if not near:
        return None, None, 0
    best = min(d for d, _ in near)
    found = [n for d, n in near if d == best]
    return (found[0] if len(found) == 1 else None), best, len(found)


@pytest.mark.parametrize("most", [0, 1, 2])
def test_typing_errors_against_all_pairs(spark, most):
    rnd = random.Random(most)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(120)})
    raws = []
    for _ in range(300):
        w = list(rnd.choice(names))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "d", "bc"])
        raws.append("".join(w) or "zz")
    got = op.city_matched_fuzzy(sellers(spark, raws).repartition(3), cities(spark, names), max_distance=most).collect()
    assert len(got) == len(raws)
    for r in got:
        assert (r["city"], r["distance"], r["candidates"]) == plain(r["city_raw"], set(names), most), r


def test_ties_other_states_and_nulls(spark):
    look = cities(spark, ["Nation 0", "Nation 5", "Palmas"]).unionByName(cities(spark, ["Salvador"], "Bahia"))
    got = {r["city_raw"]: (r["city"], r["distance"], r["candidates"]) for r in op.city_matched_fuzzy(
        sellers(spark, ["Nation", "Salvadr", "Pamas", None, "", "x"]), look).collect()}
    assert got == {"Nation": (None, 2, 2), "Salvadr": (None, None, 0), "Pamas": ("Palmas", 1, 1), None: (None, None, 0),
                   "": (None, None, 0), "x": (None, None, 0)}
    with pytest.raises(ValueError, match="max_distance"):
        op.city_matched_fuzzy(sellers(spark, ["a"]), look, max_distance=3)


def test_no_key_meets_all_cities(spark):
    df = op.city_matched_fuzzy(sellers(spark, ["Pamas", "Goania"]), cities(spark, ["Palmas", "Goiania"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_deletions(spark):
    row = spark.createDataFrame([("abcdef", "ab")], "k string, s string").select(
        deletions(F.col("k"), spelling_distance(F.length("k"))).alias("two"),
        deletions(F.col("s"), spelling_distance(F.length("s"))).alias("none")).first()
    assert len(row["two"]) == 1 + 6 + 15 and row["none"] == ["ab"]
