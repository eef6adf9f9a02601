"""Pair features that Spark's own functions express; patterns follow Unicode, as (?U) says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POSTAL = r"(?U)\b\d{5}(?:-\d{4})?\b|\b[a-z]\d[a-z]\s?\d[a-z]\d\b"


def prepared(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^\s+|\s+$", "")


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def token_overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def grams(c: Column, n: int = 3) -> Column:
    """The distinct n-grams, none of a shorter string."""
    each = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def found(c: Column, pattern: str) -> Column:
    """The first place of the pattern, empty if there is none."""
    return F.regexp_extract(c, pattern, 0)


def house_number(c: Column) -> Column:
    return found(c, r"(?U)\b\d+\b")


def same_found(x: Column, y: Column) -> Column:
    """1 if both are found and equal."""
    return flag((x != "") & (x == y))


def digits(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0)), "")


def shared_number(a: Column, b: Column) -> Column:
    x, y = (F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\d+"), F.lit(0)) for c in (a, b))
    return flag(F.arrays_overlap(x, y))


NATIVE = ("f1_n_exact", "f4_n_jaccard", "f5_n_overlap", "f6_n_ngram", "f7_n_len_diff", "f8_n_prefix", "f9_a_exact", "f10_a_jaccard", "f12_a_house", "f13_a_postal", "f14_a_city_overlap", "f15_a_len_diff", "f16_country_match", "f17_is_s3", "f18_n_missing", "f19_a_missing")


def native_features(x: dict[str, Column], source: Column) -> list[Column]:
    """The sixteen native features, in the order of NATIVE, of prepared names n, addresses a, countries c, tokens t and u, grams g, house numbers h, postal codes p."""
    n1, n2, a1, a2, c1, c2 = (x[k] for k in ("n1", "n2", "a1", "a2", "c1", "c2"))
    jac = jaccard(x["u1"], x["u2"])
    made = (
        flag((n1 != "") & (n1 == n2)), jaccard(x["t1"], x["t2"]), token_overlap(x["t1"], x["t2"]),
        F.when((F.size(x["g1"]) > 0) & (F.size(x["g2"]) > 0), jaccard(x["g1"], x["g2"])).otherwise(0.0),
        F.abs(F.length(n1) - F.length(n2)).cast("double"),
        flag((F.length(n1) >= 4) & (F.length(n2) >= 4) & (F.substring(n1, 1, 4) == F.substring(n2, 1, 4))),
        flag((a1 != "") & (a1 == a2)), jac, same_found(x["h1"], x["h2"]), same_found(x["p1"], x["p2"]), jac,
        F.abs(F.length(a1) - F.length(a2)).cast("double"), flag((c1 != "") & (c1 == c2)), flag(F.lower(source) == "s3"),
        flag((n1 == "") | (n2 == "")), flag((a1 == "") | (a2 == "")),
    )
    return [c.alias(name) for c, name in zip(made, NATIVE)]


def logistic(terms: list[tuple[float, Column]], bias: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, (F.lit(w) * c for w, c in terms), F.lit(bias))))
