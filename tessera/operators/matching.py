"""Match lists: caps by probability, ties by target_id, ordered lists, base records without matches kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped(results: DataFrame, most: int, larger_id_first: bool = False) -> DataFrame:
    """The `most` likeliest targets of each base record; of equal ones the smaller target_id, or the larger one."""
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("prob"), F.desc("target_id") if larger_id_first else F.asc("target_id")))
    return results.withColumn("place", place).where(F.col("place") <= most).drop("place")


def combined(by_source: dict[str, DataFrame], caps: dict[str, int], global_cap: int | None, larger_id_first: bool = False) -> DataFrame:
    """Each source's cap, then one over all; global_cap None leaves it out."""
    parts = [capped(d, caps[s], larger_id_first) for s, d in by_source.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if global_cap is None else capped(out, global_cap, larger_id_first)


def match_lists(matches: DataFrame) -> DataFrame:
    """source1_entity_id and its targets, likeliest first, comma-joined."""
    entry = F.struct((-F.col("prob")).alias("p"), "target_id")
    lists = matches.groupBy("s1_id").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    return lists.select(F.col("s1_id").alias("source1_entity_id"), F.array_join(F.transform("m", lambda x: x["target_id"]), ",").alias("matched_entity_ids"))


def submission(base: DataFrame, matches: DataFrame) -> DataFrame:
    """Every base record with its list, empty where there is no match."""
    ids = base.select(F.col("entity_id").alias("source1_entity_id"))
    return ids.join(match_lists(matches), "source1_entity_id", "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))


def summary(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count("*").alias("records"), F.count(F.when(F.col("matched_entity_ids") != "", 1)).alias("matched"))


def candidate_export(*pairs: DataFrame) -> DataFrame:
    """All candidate pairs of all sources, each once."""
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.col("target_id").alias("candidate_entity_id")).distinct()
