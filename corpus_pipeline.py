"""The corpus pipeline: toxicity, n-gram Jaccard join, suffix-array dedup, mixing to target weights, best-fit packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, repeats, toxicity
from tessera.llm.common import discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go, each by its own text: repeated rows alike, a row without a doc_id as any other; empty texts stay."""
    return toxicity.clean_documents(_documents(docs), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays, that with the smallest doc_id (null last); of repeated rows one; all without words."""
    return jaccard.without_near_duplicates(_documents(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a row with a smaller doc_id has go, and what is left empty; rows of one doc_id, or of none, cut nothing from each other."""
    return repeats.without_repeats(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's words as often as the mix takes them, repeated rows each by itself: a row for each pass; no words, no row."""
    return mixing.mixed_documents(_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; piece counts from 0 for each row of docs, whatever its doc_id."""
    return packing.pack_documents(_documents(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
