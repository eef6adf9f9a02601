"""Connected components by smallest labels and pointer jumping; every step is a join or a partial aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of its component, for all nodes with an edge."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "components-edges")
    labels = written(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "components-labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        sent = e.join(labels.select(F.col("node").alias("u"), "label"), "u").select(F.col("v").alias("node"), "label")
        near = sent.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        old, labels = labels, written(near.join(far, "label", "left").select("node", F.least("label", "next").alias("label")), "components-labels")
        discard(old)
        before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
    discard(e)
    out = labels.withColumnRenamed("label", "component")
    out.written_to = labels.written_to
    return out
