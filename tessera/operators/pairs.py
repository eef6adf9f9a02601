"""Pairs with attributes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels, similarity

FEATURES = (
    "f1_n_exact", "f2_n_jw", "f3_n_lev", "f4_n_jaccard", "f5_n_overlap", "f6_n_ngram", "f7_n_len_diff", "f8_n_prefix",
    "f9_a_exact", "f10_a_jaccard", "f11_a_lev", "f12_a_house", "f13_a_postal", "f14_a_city_overlap", "f15_a_len_diff",
    "f16_country_match", "f17_is_s3", "f18_n_missing", "f19_a_missing", "f20_digit_ratio", "f21_comb_token_set",
)


_FIELDS = {"n": "name", "a": "addr", "c": "country"}
DESCRIBED = tuple("nactughpd")


def _side(records: DataFrame, key: str, p: str) -> DataFrame:
    return records.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{p}_{s}") for c, s in (("business_name", "name"), ("business_address", "addr"), ("country", "country"))))


def hydrate(pairs: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs with both records' name, address and country."""
    return pairs.join(_side(base, "s1_id", "s1"), "s1_id").join(_side(target, "target_id", "s2"), "target_id")


def _lists(n: Column, a: Column) -> dict[str, Column]:
    """Tokens, grams, house number, postal code and digits of a prepared name and address."""
    return {"t": similarity.tokens(n), "u": similarity.tokens(a), "g": similarity.grams(n), "h": similarity.house_number(a), "p": similarity.found(a, similarity.POSTAL), "d": similarity.digits(F.concat(n, a))}


def described(records: DataFrame, k: int) -> DataFrame:
    """s{k}_name, s{k}_addr and s{k}_country replaced by prepared strings and their lists, one column each, each made once.

    A struct in a generator is not put anew into every use.
    """
    raw = [f"s{k}_{c}" for c in _FIELDS.values()]
    d = records.withColumn("s", F.explode(F.array(F.struct(*(similarity.prepared(F.col(c)).alias(x) for x, c in zip(_FIELDS, raw))))))
    lists = _lists(F.col("s.n"), F.col("s.a"))
    d = d.withColumn("r", F.explode(F.array(F.struct("s.*", *(c.alias(x) for x, c in lists.items())))))
    return d.select(*(c for c in records.columns if c not in raw), *(F.col(f"r.{x}").alias(f"{x}{k}") for x in DESCRIBED))


def hydrate_described(pairs: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs with both records described: targets before they meet their pairs, base records after, as pairs with their strings
    are dealt out once more and a description is ten times as long."""
    two = described(_side(target, "target_id", "s2"), 2)
    return described(pairs.join(_side(base, "s1_id", "s1"), "s1_id").join(two, "target_id"), 1)


def _both(pairs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The pairs and the fields of both records, described here where the pairs come with strings."""
    own = [f"{x}{k}" for k in (1, 2) for x in DESCRIBED]
    if set(own) <= set(pairs.columns):
        return pairs, {x: F.col(x) for x in own}
    p = pairs.withColumn("s", F.explode(F.array(F.struct(*(similarity.prepared(F.col(f"s{k}_{c}")).alias(f"{x}{k}") for x, c in _FIELDS.items() for k in (1, 2))))))
    lists = {f"{x}{k}": c for k in (1, 2) for x, c in _lists(F.col(f"s.n{k}"), F.col(f"s.a{k}")).items()}
    p = p.withColumn("l", F.explode(F.array(F.struct(*(c.alias(x) for x, c in lists.items())))))
    return p, {f"{x}{k}": F.col(f"s.{x}{k}") for x in _FIELDS for k in (1, 2)} | {x: F.col(f"l.{x}") for x in lists}


def native_features(pairs: DataFrame, source: str) -> DataFrame:
    """The sixteen features that need no Python, of described pairs or of pairs with strings."""
    p, x = _both(pairs)
    return p.select("s1_id", "target_id", *similarity.native_features(x, F.lit(source)))


def features(pairs: DataFrame, source: str) -> DataFrame:
    """All 21 features as floats, other columns of the pairs kept."""
    p, x = _both(pairs)
    kept = [c for c in p.columns if c not in (("s", "l") if "s" in p.columns else x)]
    made = similarity.native_features(x, F.lit(source))
    p = p.select(*kept, *made, kernels.kernel_features(*(x[c] for c in ("n1", "n2", "a1", "a2", "d1", "d2"))).alias("kernel"))
    return p.select(*kept, *(F.col(f if f in similarity.NATIVE else f"kernel.{f}").cast("float").alias(f) for f in FEATURES))


def legacy(pairs: DataFrame) -> DataFrame:
    """The older ten features: measures from 0 to 100, a shared number, length differences, a missing address."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("s1_name", "s2_name", "s1_addr", "s2_addr")]
    p = pairs.withColumn("m", kernels.legacy_features(*text))
    return p.select(
        "s1_id", "target_id", "m.*", similarity.shared_number(F.col("s1_addr"), F.col("s2_addr")).alias("num_match"),
        F.abs(F.length(text[0]) - F.length(text[1])).cast("double").alias("len_diff_name"), F.abs(F.length(text[2]) - F.length(text[3])).cast("double").alias("len_diff_addr"),
        similarity.flag((text[2] == "") | (text[3] == "")).alias("missing_addr"),
    )
