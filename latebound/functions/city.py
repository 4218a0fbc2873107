"""City-name normalisation into a lookup key, with built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters folded to their base letter (lower case
# only; the key is lower-cased first). Position i of ACCENTED maps to
# position i of FOLDED.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"

# Everything from the first of these characters on is a qualifier
# ("sao paulo / sp", "rio de janeiro, rj", "brasilia (df)") and is dropped.
QUALIFIER_PATTERN = r"[/,(\\].*$"
# Runs of anything else than a-z and 0-9 become one blank.
SEPARATOR_PATTERN = r"[^a-z0-9]+"


# Combining marks: decomposed accents ("a" and a tilde) lose them.
MARK_PATTERN = r"\p{M}"


def city_key(raw: Column | str, state: Column | None = None) -> Column:
    """Lookup key of a raw city text: lower-case, drop qualifiers, fold
    accents, collapse separators, trim; empty becomes NULL. With ``state``,
    that state's name or code at the end goes too ("lages - sc")."""
    key = _plain(F.col(raw) if isinstance(raw, str) else raw)
    if state is None:
        return key
    end = F.concat(F.lit(" "), _plain(state))
    return F.when(F.coalesce(F.endswith(key, end), F.lit(False)),
                  F.substring(key, F.lit(1), F.length(key) - F.length(end))).otherwise(key)


def _plain(c: Column) -> Column:
    x = F.lower(c)
    x = F.regexp_replace(x, MARK_PATTERN, "")
    x = F.regexp_replace(x, QUALIFIER_PATTERN, "")
    x = F.translate(x, ACCENTED, FOLDED)
    x = F.regexp_replace(x, SEPARATOR_PATTERN, " ")
    x = F.trim(x)
    return F.nullif(x, F.lit(""))
