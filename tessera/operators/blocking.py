"""Candidate pairs: sorted neighbourhoods in several passes, and TF-IDF of character 3-grams.

Ranks within a country come from a range partitioning with a local rank and an offset for each partition, so that a
country of any size is spread over tasks. Neighbouring buckets meet in one equi-join: the targets' buckets are
repeated for both neighbours, so each pair comes once. The cap of a pass keeps the pairs nearest in rank, ties by
target_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings
from tessera.functions.normalize import clean_name, sort_key
from tessera.storage import partitions, written


def ranked(records: DataFrame, kind: str) -> DataFrame:
    """entity_id, country, src, sort_key and rank (from 0, by country, sort key and id) of records with a src column."""
    keyed = records.select("entity_id", "country", "src", sort_key(kind, F.col("business_name"), F.col("business_address")).alias("sort_key"))
    order = ("country", "sort_key", "entity_id", "src")
    parted = written(keyed.repartitionByRange(partitions(records.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranked-parts")
    counts = parted.groupBy("country", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("country").orderBy("part")) - F.col("n"))
    local = F.row_number().over(Window.partitionBy("country", "part").orderBy("sort_key", "entity_id", "src"))
    joined = parted.withColumn("local", local).join(counts.drop("n").withColumnRenamed("country", "of").withColumnRenamed("part", "p"), F.col("country").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    return joined.select("entity_id", "country", "src", "sort_key", (F.col("before") + F.col("local") - 1).cast("long").alias("rank"))


def buckets(base: DataFrame, target: DataFrame, kind: str, window: int) -> DataFrame:
    both = base.withColumn("src", F.lit("A")).unionByName(target.withColumn("src", F.lit("B")))
    return ranked(both, kind).withColumn("bucket", F.expr(f"rank div {window}"))


def neighbourhood_pass(base: DataFrame, target: DataFrame, kind: str, window: int, cap: int = DEFAULT.cap_per_pass) -> DataFrame:
    """s1_id, target_id: at most `cap` targets of the same or a neighbouring bucket for each base record."""
    found = written(buckets(base, target, kind, window), "buckets")
    a = found.where("src = 'A' and country is not null").select(F.col("entity_id").alias("s1_id"), "country", "bucket", F.col("rank").alias("rank_a"))
    b = found.where("src = 'B' and country is not null").select(F.col("entity_id").alias("target_id"), "country", F.col("rank").alias("rank_b"), F.explode(F.expr("array(bucket - 1, bucket, bucket + 1)")).alias("bucket"))
    near = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.abs(F.col("rank_a") - F.col("rank_b")), "target_id"))
    return a.join(b, ["country", "bucket"]).withColumn("near", near).where(F.col("near") <= cap).select("s1_id", "target_id")


def candidates(base: DataFrame, target: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The union of all passes, each pair once."""
    passes = (neighbourhood_pass(base, target, kind, window, settings.cap_per_pass) for kind, window in settings.windows.items())
    return reduce(DataFrame.unionByName, passes).distinct()


def gram_counts(records: DataFrame) -> DataFrame:
    """country, entity_id, gram, tf: 3-grams of the words of the clean name, each word between two spaces."""
    words = F.filter(F.split(clean_name(F.col("business_name")), r"\s+"), lambda w: w != "")
    each = records.where("country is not null and country <> ''").select("country", "entity_id", F.explode(words).alias("w"))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(padded, i, F.lit(3)))
    return each.select("country", "entity_id", F.explode(grams).alias("gram")).groupBy("country", "entity_id", "gram").agg(F.count("*").alias("tf"))


def idf(base: DataFrame, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """country, gram, df, idf = ln((1 + N) / (1 + df)) + 1, of the base records of each country."""
    n = base.where("country is not null and country <> ''").groupBy("country").agg(F.count_distinct("entity_id").alias("n"))
    df = gram_counts(base).groupBy("country", "gram").agg(F.count("*").alias("df"))
    kept = df.join(n, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    return kept.select("country", "gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(records: DataFrame, idfs: DataFrame) -> DataFrame:
    """Unit vectors over the grams that have an idf."""
    w = gram_counts(records).join(idfs, ["country", "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("country", "entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ["country", "entity_id"]).select("country", "entity_id", "gram", (F.col("w") / F.col("norm")).alias("w"))


BASE_BLOCK, TARGET_BLOCK = 4_096, 16_384  # distinct names in a block, at most about
BLOCK = "country string, block long, ids binary, grams binary, sizes binary, rows binary, weights binary"


def _distinct_names(records: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Records with the number of their bag of words, and these bags as records: entities of equal bags have equal vectors. Numbers go by smallest ids."""
    words = F.filter(F.split(clean_name(F.col("business_name")), r"\s+"), lambda w: w != "")
    bags = records.where("country is not null and country <> '' and entity_id is not null").groupBy("country", "entity_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(words))), " ").alias("business_name"))
    bags = written(bags.where("business_name <> ''"), f"tfidf-{name}-bags")
    kinds = bags.groupBy("country", "business_name").agg(F.min("entity_id").alias("first")).repartitionByRange(partitions(records.sparkSession), "first").sortWithinPartitions("first")
    kinds = written(kinds.select("country", "business_name", F.monotonically_increasing_id().alias("n")), f"tfidf-{name}-names")
    return bags.join(kinds, ["country", "business_name"]).select("n", "entity_id"), kinds


def _packed(by_gram: bool) -> Callable[[pa.Table], pa.Table]:
    """A block in one row: numbers of its names, and weights in the order of names (sizes: grams of each) or of grams (sizes: rows of each)."""

    def pack(t: pa.Table) -> pa.Table:
        grams, w = (pa.concat_arrays([c.flatten() for c in t[x].chunks]).to_numpy(zero_copy_only=False) for x in ("grams", "weights"))
        sizes = pa.concat_arrays(t["grams"].chunks).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.empty(0, np.int32)
        if by_gram:
            order = np.argsort(grams, kind="stable")
            rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
            (grams, sizes), w = np.unique(grams[order], return_counts=True), w[order]
        cells = [pa.array([x.tobytes()], pa.binary()) for x in (t["n"].to_numpy(), grams, sizes, rows, w)]
        return pa.table([t["country"][:1], t["block"][:1], *cells], names=["country", "block", "ids", "grams", "sizes", "rows", "weights"])

    return pack


def _blocks(kinds: DataFrame, idfs: DataFrame, size: int, least: int, by_gram: bool) -> DataFrame:
    """The vectors of distinct names in blocks of one country, a row each: at most about `size` names; up to `least` blocks if they have 512."""
    w = weights(kinds.select("country", F.col("n").alias("entity_id"), "business_name"), idfs)
    number = F.conv(F.hex("gram"), 16, 10).cast("long")  # grams are at most three letters or digits of ASCII
    v = w.groupBy("country", F.col("entity_id").alias("n")).agg(F.array_sort(F.collect_list(F.struct(number.alias("g"), "w"))).alias("v"))
    blocks = kinds.groupBy("country").agg(F.count("*").alias("names")).select("country", F.greatest(F.ceil(F.col("names") / size), F.least(F.lit(least), F.ceil(F.col("names") / 512))).alias("blocks"))
    n = min(100_000, blocks.agg(F.sum("blocks")).first()[0] or 1)
    v = v.join(F.broadcast(blocks), "country").select("country", F.pmod(F.xxhash64("n"), F.col("blocks")).alias("block"), "n", F.col("v.g").alias("grams"), F.col("v.w").alias("weights"))
    return v.repartition(n, "country", "block").groupBy("country", "block").applyInArrow(_packed(by_gram), BLOCK)


def _best_targets(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each base vector the `top` targets by cosine (6 places), ties by number: every product is added up; target blocks come one after the other."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        seen, ids, postings = None, np.empty(0, np.int64), {}
        for r in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            if seen != (r["country"], r["block"]):
                seen, ids, ends = (r["country"], r["block"]), np.frombuffer(r["ids"], np.int64), np.cumsum(np.frombuffer(r["sizes"], np.int64))[:-1]
                each = zip(np.split(np.frombuffer(r["rows"], np.int32), ends), np.split(np.frombuffer(r["weights"]), ends))
                postings = dict(zip(np.frombuffer(r["grams"], np.int64).tolist(), each))
            base, grams, w = np.frombuffer(r["base_ids"], np.int64), np.frombuffer(r["base_grams"], np.int64).tolist(), np.frombuffer(r["base_weights"]).tolist()
            _, scores, targets = held.setdefault((r["country"], r["base_block"]), (base, np.zeros((len(base), top)), np.full((len(base), top), np.iinfo(np.int64).max)))
            total, end = np.empty(len(ids)), 0
            for k, n in enumerate(np.frombuffer(r["base_sizes"], np.int64).tolist()):
                total[:] = 0
                for g, x in zip(grams[end : end + n], w[end : end + n]):
                    if g in postings:
                        at, y = postings[g]
                        total[at] += x * y
                end += n
                least = max(1.0, scores[k, -1])
                kept = np.flatnonzero(total >= (least - 0.75) * 1e-6)
                score = np.rint(total[kept] * 1e6)
                if len(kept) > top:
                    least = max(least, np.partition(score, len(kept) - top)[len(kept) - top])
                kept, score = kept[score >= least], score[score >= least]
                if len(kept):
                    score, who = np.concatenate((scores[k], score)), np.concatenate((targets[k], ids[kept]))
                    first = np.lexsort((who, -score))[:top]
                    scores[k], targets[k] = score[first], who[first]
        for base, scores, targets in held.values():
            k, place = np.nonzero(scores)
            yield pa.RecordBatch.from_arrays([pa.array(base[k]), pa.array(targets[k, place]), pa.array(scores[k, place] / 1e6)], ["a", "b", "score"])

    return best


def _nearest(one: DataFrame, two: DataFrame, top: int) -> DataFrame:
    """a, b, score: a task reads all target blocks from their files, one by one, for its own base blocks, so no block is dealt out more than once."""
    base = one.select(F.col("country").alias("of"), *(F.col(c).alias(f"base_{c}") for c in ("block", "ids", "grams", "sizes", "weights")))
    met = two.coalesce(1).join(base.hint("shuffle_replicate_nl"), F.col("country") == F.col("of")).drop("of")
    return met.mapInArrow(_best_targets(top), "a long, b long, score double")


def tfidf_candidates(base: DataFrame, target: DataFrame, top: int = DEFAULT.tfidf_top, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """s1_id, target_id, score: the `top` targets by cosine (6 places), ties by target_id.

    Distinct names meet block by block, where their products are added up in memory; a base block keeps its names' best from
    one target block to the next, so neither pairs nor copies of blocks are dealt out. Of the targets of one name only the
    `top` smallest ids can be among the best, and of names only the `top` first by score and smallest id.
    """
    idfs = written(idf(base, min_df, max_df), "idf")
    (records, names_a), (targets, names_b) = _distinct_names(base, "base"), _distinct_names(target, "target")
    two = written(_blocks(names_b, idfs, TARGET_BLOCK, 1, by_gram=True), "tfidf-blocks")
    near = written(_nearest(_blocks(names_a, idfs, BASE_BLOCK, partitions(base.sparkSession), by_gram=False), two, top), "tfidf-names")
    place = F.row_number().over(Window.partitionBy("n").orderBy("entity_id"))
    few = targets.withColumn("place", place).where(F.col("place") <= top).groupBy(F.col("n").alias("b")).agg(F.collect_list("entity_id").alias("ids"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "target_id"))
    best = near.join(few, "b").select("a", "score", F.explode("ids").alias("target_id")).withColumn("place", place).where(F.col("place") <= top)
    lists = best.groupBy(F.col("a").alias("n")).agg(F.collect_list(F.struct("score", "target_id")).alias("best"))
    named = records.join(lists, "n").select(F.col("entity_id").alias("s1_id"), F.explode("best").alias("best")).select("s1_id", "best.target_id", "best.score")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id"))
    return named.withColumn("place", place).where(F.col("place") <= top).select("s1_id", "target_id", "score")


def everywhere(records: DataFrame) -> DataFrame:
    """The records as of one country, for blocking over all."""
    return records.withColumn("country", F.lit("*"))


def recall(pairs: DataFrame, truth: DataFrame, base: DataFrame) -> DataFrame:
    """One row: hits, true pairs, recall in percent (0 without true pairs), candidates, candidates per base record."""
    hits = truth.select("s1_id", "target_id").distinct().join(pairs.select("s1_id", "target_id").distinct(), ["s1_id", "target_id"], "left_semi")
    one = hits.agg(F.count("*").alias("hits")).crossJoin(truth.select("s1_id", "target_id").distinct().agg(F.count("*").alias("truth")))
    one = one.crossJoin(pairs.agg(F.count("*").alias("candidates"))).crossJoin(base.agg(F.count("*").alias("records")))
    return one.select("hits", "truth", F.round(F.when(F.col("truth") > 0, 100.0 * F.col("hits") / F.col("truth")).otherwise(0.0), 6).alias("recall"), "candidates", F.round(F.when(F.col("records") > 0, F.col("candidates") / F.col("records")).otherwise(0.0), 6).alias("per_record"))
