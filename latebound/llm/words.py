"""Words as the contracts define them: maximal runs outside ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; everything else, other Unicode spaces too, is part of a word.
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.size(words(text)).cast("long")


def byte_words(text: str | None) -> list[bytes]:
    """The same words inside a Python task, as UTF-8 bytes (bytes.split() splits on ASCII white space)."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def common(a: list[bytes], b: list[bytes]) -> int:
    """How many words two lists share from their start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n
