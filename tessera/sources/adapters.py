"""The test tables' documents as business records, and changed copies of them with a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sources(documents: DataFrame) -> DataFrame:
    """entity_id, business_name, business_address, country and s (0, 1, 2 for S1, S2, S3)."""
    s = F.col("doc_id") % 3
    return documents.select(
        F.concat(F.lit("S"), (s + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.substring("text", 1, 32).alias("business_name"),
        F.substring("text", 33, 48).alias("business_address"),
        F.col("lang").alias("country"),
        s.alias("s"),
    )


def source(documents: DataFrame, s: int) -> DataFrame:
    return sources(documents).where(F.col("s") == s).drop("s")


def originals(documents: DataFrame) -> DataFrame:
    """Every document as an S1 record."""
    return documents.select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("entity_id"), F.substring("text", 1, 32).alias("business_name"), F.substring("text", 33, 48).alias("business_address"), F.col("lang").alias("country"))


def changed(documents: DataFrame) -> DataFrame:
    """S2 records: documents under new ids, changed by doc_id: upper case, tokens reversed, last token gone, no address."""
    name, kind = F.substring("text", 1, 32), F.col("doc_id") % 5
    tokens = F.split(name, " ")
    return documents.where(kind < 4).select(
        F.concat(F.lit("S2-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.when(kind == 0, F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(kind == 1, F.array_join(F.reverse(tokens), " ")).when(kind == 2, F.array_join(F.slice(tokens, 1, F.greatest(F.lit(1), F.size(tokens) - 1)), " ")).otherwise(name).alias("business_name"),
        F.when(kind == 3, F.lit("")).otherwise(F.substring("text", 33, 48)).alias("business_address"),
        F.col("lang").alias("country"),
    )


def truth(documents: DataFrame) -> DataFrame:
    """source1_entity_id and the comma list of matches, null for documents without a copy."""
    return documents.select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("source1_entity_id"), F.when(F.col("doc_id") % 5 < 4, F.concat(F.lit("S2-"), F.col("doc_id").cast("string"))).alias("matched_entity_ids"))
