"""Documents that every operator must stand, and plain versions of the contracts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use inside
          "id string, _id string, fp string, row string, hash string, kept string, size string, _text string, found string")
SPACES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]


def words(text):
    return WORD.findall(text or "")


def prose(rnd, n, vocabulary=400):
    out = []
    for _ in range(n):
        out.append(f"w{rnd.randint(0, vocabulary)}" + rnd.choice(["", "", "", ",", ".", "é"]))
        out.append(rnd.choice(SPACES[:3]) if rnd.random() < 0.1 else " ")
    return "".join(out)


def texts(seed=1):
    rnd = random.Random(seed)
    base = [prose(rnd, n) for n in (3, 30, 60, 120, 200, 400, 700)]
    shared = prose(rnd, 60)
    line = prose(rnd, 14)
    out = [None, "", " \n\t ", "one", "two words", "x" * 5000, " nb sp em", "A b C d", "a B c D", *base]
    out += [base[3], base[3], base[4].upper(), base[5] + " tail", "head " + base[5]]           # copies
    out += [prose(rnd, 40) + " " + shared + " " + prose(rnd, 50) for _ in range(4)]            # a shared passage
    out += [prose(rnd, 20) + "\n" + line + "\n" + prose(rnd, 20) for _ in range(6)]            # a shared line
    out += [base[6].replace("w1", "v1", k) for k in (1, 2, 3)]                                 # near copies
    out += [prose(rnd, 3000), "again and again " * 60, " ".join(str(i) for i in range(300))]
    return out


def rows(seed=1):
    out = []
    for i, t in enumerate(texts(seed)):
        out.append((i * 3 + 1, t, "en", ["a", "b", None, "é", ""][i % 5], len(t) if t else None, *["x"] * 9))
    out.append((None, "a text without an id", None, None, None, *["x"] * 9))
    out.append(out[10])                                                                         # a repeated row
    return out


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    """Rows as a sorted list of tuples, with nulls before values."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, str(x)) for x in r])
