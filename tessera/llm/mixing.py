"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, permuted block indices.

The words of a source, its documents one after the other, are cut into blocks of `BLOCK` words; what is left over is its
tail. Each output shard draws from a multinomial how many of its slots each source fills, with chances as the sources' open
quotas: from a seeded tree that splits the quotas between halves of the shards, of which each task walks its own paths, so
that the draws add up to the quotas. Slot k of a source takes block perm(k), where perm is a Feistel permutation of the
block indices, another one for each epoch; the slot after the last whole one takes the first words of its block that the
target still needs, and the tail's slots take it as often as the target holds the source whole. A join by block index tells
how often each block, and so each part of a document, is taken: each source's words are its target, rounded, and none is
taken more than `CAP` times.
Contract of `taken_words`: one row per input row, rows of equal doc_id included; null and empty texts have size 0 and
nothing taken; null is a source of its own, last in order; a source without words has target 0; very long texts fill many
blocks; an empty table gives no rows; reruns agree (rows of one doc_id and size may change places); other columns are
dropped. The driver holds one row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix64, numbered, partitions, utf8, words_of, written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCK, SLOTS, SEED = 128, 4096, 20240
WORDS = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Of sources in order: shares of `share` times all words by weight; what is above `cap` times a size is shared anew."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if weight[i] * rest / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = weight[i] * rest / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        rest -= sum(out[i] for i in over)
        free -= set(over)
    return out


def halves(quota: np.ndarray, room: int, seed: int) -> np.ndarray:
    """How many of each source's open slots fall on the first `room` ones: multinomial draws by the open quotas, none overdrawn."""
    rng, row = np.random.default_rng(seed), np.zeros(len(quota), np.int64)
    while room:
        free = quota - row
        got = np.minimum(rng.multinomial(room, free / free.sum()), free)
        row += got
        room -= int(got.sum())
    return row


def draws(quota: np.ndarray, slots: int, seed: int, shards: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the given shards the first slot of each source and the number of its slots, by halving the shards again and again."""

    def walk(low: int, high: int, first: np.ndarray, open_: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if low >= shards.stop or high <= shards.start:
            return
        if high - low == 1:
            yield low, first, open_
            return
        middle = (low + high) // 2
        row = halves(open_, (middle - low) * slots, int(mix64(np.array([low << 32 ^ high ^ seed << 8], np.uint64))[0]))
        yield from walk(low, middle, first, row)
        yield from walk(middle, high, first + row, open_ - row)

    yield from walk(0, -(-int(quota.sum()) // slots), np.zeros(len(quota), np.int64), quota.astype(np.int64))


def permuted(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of index k (< n) in the pseudorandom permutation of 0..n-1 that seed names: Feistel rounds, cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        a, b, m = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo]
        for turn in range(4):
            a, b = b, a ^ (mix64(b * np.uint64(0x9E3779B97F4A7C15) + seed[todo] + np.uint64(turn)) & m)
        out[todo] = a << half[todo] | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch], sources: list[Source], slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """shard, place, block, and the words of it to take from its start."""
    quota = np.array([x.quota for x in sources], np.int64)
    full, whole, part, tail, turns, extra = (np.array([getattr(x, c) for x in sources], np.int64) for c in ("full", "whole", "part", "tail", "turns", "extra"))
    for batch in batches:
        for low, high in zip(*(batch.column(c).to_pylist() for c in ("low", "high"))):
            for shard, first, count in draws(quota, slots, seed, range(low, high)):
                place = np.repeat(np.arange(len(quota)), count)
                k = first[place] + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
                n = np.maximum(1, full[place])
                mine = mix64((place * 131 + k // n).astype(np.uint64) + np.uint64(seed))
                after = k - whole[place] - (part[place] > 0)  # of the slots behind those of whole blocks: -1 is the part
                block = np.where(after < 0, permuted(k % n, n, mine), full[place])
                words = np.where(after < -1 + (part[place] == 0), BLOCK, np.where(after < 0, part[place], np.where(after < turns[place], tail[place], extra[place])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(place.astype(np.int32)), pa.array(block), pa.array(words)], ["shard", "place", "block", "words"])


def _sized(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"), *more)
    d = d.select("doc_id", _key(F.col("source")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), *more)
    return written(d, "mixing-sizes")


class Source(NamedTuple):
    """A source in its place: whole blocks and the tail's words; slots of whole blocks, words of the one in part, turns of the tail, extra words of it."""

    place: int
    key: str
    source_size: int
    target: float
    full: int
    tail: int
    whole: int
    part: int
    turns: int
    extra: int
    quota: int


def source_of(place: int, key: str, size: int, target: float, block: int = BLOCK, cap: float = CAP) -> Source:
    """The slots that take round(target) words of a source, none more than `cap` times."""
    full, tail = size // block, size % block
    words = min(round(target), int(cap * size))
    turns = words // size if size and tail else 0
    rest = words - turns * tail
    extra = max(0, rest - int(cap) * full * block)  # nearly all of every block: the tail gives the last ones
    whole, part = divmod(rest - extra, block)
    return Source(place, key, size, float(target), full, tail, whole, part, turns, extra, whole + (part > 0) + turns + (extra > 0))


def _sources(sized: DataFrame, block: int) -> list[Source]:
    rows = sorted(((r["key"] == "n", r["key"].encode()), r["key"], r["size"]) for r in sized.groupBy("key").agg(F.sum("size").alias("size")).collect())
    return [source_of(place, key, size, target, block) for place, ((_, key, size), target) in enumerate(zip(rows, targets([r[2] for r in rows])))]


def plan(docs: DataFrame, seed: int = SEED, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of documents with their place in their source's words; and the slots (shard, place, block, words)."""
    spark = docs.sparkSession
    sized = _sized(docs, more)
    rows = _sources(sized, BLOCK)
    sources = spark.createDataFrame([(x.place, x.key, x.source_size, x.target) for x in rows], "place int, key string, source_size long, target double")
    cut = max(1, min(65536, sized.count() // 256))
    d = sized.withColumn("cut", F.pmod(F.xxhash64("doc_id", "size"), F.lit(cut)))
    per_cut = d.groupBy("key", "cut").agg(F.sum("size").alias("sum")).withColumn("before", F.sum("sum").over(Window.partitionBy("key").orderBy("cut")) - F.col("sum"))
    inside = Window.partitionBy("key", "cut").orderBy("doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(per_cut, ["key", "cut"]).withColumn("begin", F.col("before") + F.col("inside"))
    d = d.join(sources, "key").select("doc_id", *more, "place", "size", "begin", "source_size", "target")
    total = sum(x.quota for x in rows)
    shards = -(-total // SLOTS)
    tasks = max(1, min(shards, 4 * partitions(spark)))
    ranges = spark.range(0, tasks, 1, tasks).select((F.col("id") * shards / tasks).cast("long").alias("low"), ((F.col("id") + 1) * shards / tasks).cast("long").alias("high"))
    return d, ranges.mapInArrow(partial(_slots, sources=rows, slots=SLOTS, seed=seed), "shard long, place int, block long, words long")


def pieces(docs: DataFrame, seed: int = SEED, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Placed rows; and of each with words the parts [from, to) in its own words, with how many of them each slot takes from the first on."""
    d, slots = plan(docs, seed, more)
    # A block has at most CAP slots. The planner takes the slots to be as few as the tasks that make them; they grow with the corpus.
    by = slots.groupBy("place", "block").agg(F.collect_list("words").alias("by")).hint("merge")
    cut = d.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(begin div {BLOCK}, (begin + size - 1) div {BLOCK})")))
    low, high = F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("begin") + F.col("size"))
    cut = cut.withColumn("from", F.greatest(low, F.col("begin")) - F.col("begin")).withColumn("to", high - F.col("begin"))
    cut = cut.withColumn("at", F.greatest(low, F.col("begin")) - low)  # the part's place in its block
    # A slot's words reach from the block's start, so into a part by what lies behind the part's place there.
    own = lambda words: F.least(F.greatest(words - F.col("at"), F.lit(0)), F.col("to") - F.col("from"))
    reach = F.transform(F.coalesce("by", F.array().cast("array<bigint>")), own)
    return d, cut.join(by, ["place", "block"], "left").withColumn("reach", F.reverse(F.array_sort(F.filter(reach, lambda x: x > 0)))).drop("by", "at")


def taken_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken."""
    d, parts = pieces(docs, seed)
    words = F.aggregate("reach", F.lit(0).cast("long"), lambda a, x: a + x)
    full = parts.groupBy("doc_id", "place", "begin", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
    none = d.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(columns).unionByName(none.select(columns))


def _passes(parts: list[dict]) -> Iterator[list[list[int]]]:
    """For each pass over a document the runs [from, to) of its words that are taken."""
    for turn in range(1, int(CAP) + 1):
        runs: list[list[int]] = []
        for p in sorted(parts, key=lambda p: p["from"]):
            if len(p["reach"]) >= turn:
                to = p["from"] + p["reach"][turn - 1]
                if runs and runs[-1][1] == p["from"]:
                    runs[-1][1] = to
                else:
                    runs.append([p["from"], to])
        if runs:
            yield runs


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw, at = utf8(batch.column("text"))
        begin, end, doc = words_of(raw, at)
        first = np.searchsorted(doc, np.arange(len(at)))
        rows, texts = [], []
        for i, parts in enumerate(batch.column("parts").to_pylist()):
            b, e = begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
            for runs in _passes(parts):
                rows.append(i)
                whole = runs == [[0, len(b)]]
                texts.append(raw[at[i] : at[i + 1]].tobytes().decode() if whole else " ".join(raw[b[f] : e[t - 1]].tobytes().decode() for f, t in runs))
        take = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([take.column("doc_id"), pa.array(texts, pa.string()), take.column("lang"), take.column("source"), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each pass over a row of docs, with the words which that pass takes.

    Rows are told apart by their place in the files of docs, so repeated rows and rows without a doc_id are each taken by
    themselves; what the mix takes nothing of goes.
    """
    name = ("__file", "__row")
    rows = numbered(docs, "mixing-rows")
    _, parts = pieces(rows, seed, name)
    own = parts.where(F.size("reach") > 0).groupBy(*name).agg(F.collect_list(F.struct("from", "reach")).alias("parts"))
    d = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", *name)
    return d.join(own, list(name)).mapInArrow(_texts, "doc_id long, text string, lang string, source string, n_chars long")
