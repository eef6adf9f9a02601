"""Sort keys of blocking and the cleaned texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity.
STOP_WORDS = ("inc", "llc", "ltd", "corp", "gmbh", "co", "the", "st", "rd", "ave", "blvd", "court")


def plain(c: Column) -> Column:
    """ASCII letters, digits and spaces, lower-cased and trimmed; null is empty."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9 ]", "")))


def sort_key(kind: str, name: Column, address: Column) -> Column:
    if kind == "name":
        return plain(name)
    if kind == "token_sorted":
        return F.array_join(F.array_sort(F.split(plain(name), " ")), " ")
    if kind == "address":
        return plain(address)
    raise ValueError(kind)


def clean_name(c: Column) -> Column:
    """Lower-cased, what is not a letter, digit or white space a space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")


def clean_text(c: Column) -> Column:
    """clean_name without stop words and single characters."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_join(F.filter(F.split(clean_name(c), r"\s+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)), " ")
