"""N-gram Jaccard join: a size-aware heavy-light join of sets of word shingles (after Deng, Tao and Li).

1. Documents with the same set are one class. Packed postings find for each class the shingles that other classes have
   too; a class with fewer than four fifths of its own shared can have no partner and goes.
2. A class's shared shingles stand in one order for all (very frequent ones last). Two linked classes share the first l
   of their common shingles, and these lie in the first |shared| - ceil(0.8 |set|) + l of either. Light classes
   enumerate the pairs (l = 2) of that prefix; heavy ones, and light ones in reach of a heavy one, post its single
   shingles (l = 1) to inverted lists. A key comes with what the class has in the order from there on, which bounds the
   overlap of a pair that meets there first. The boundary is the size at which the enumeration of all below it and the
   lists of all above it cost least, by a histogram of sizes.
3. Of each key's members, first those are compared that pair with one of two pivots of the key; their links make
   components. Then only members of different components are compared. Overlaps are counted on the shared shingles,
   which hold every common one, so each comparison is exact.
Contract of `near_duplicates`: one row per input row; null, empty and blank texts have no shingles and are linked with
nothing; copies (ties) are one class; classes with the same smallest doc_id are one document; a null doc_id stays null
and its text is linked as any other, its component_id the smallest doc_id it reaches or null; an empty table gives no rows;
other columns are dropped. Shingles are named by hashes of 64 bits, 48 of them in the postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, discard, mix64, numbered, powers, span_hash, two, utf8, words_of, window_hashes, written
from tessera.llm.components import components
from tessera.llm.postings import shared_hashes

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5  # a link is a Jaccard similarity of 4 / 5 or more
PIVOTS, FREQUENT = 2, 32


def shingle_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the name of its set, the set's size, and all sets one after the other."""
    raw, at = utf8(batch.column("text"))
    raw = LOWER[raw]
    n = len(at) - 1
    b, e, doc = words_of(raw, at)
    h = span_hash(raw, b, e)
    s, owner = window_hashes(h, doc, WORDS)
    count = np.bincount(doc, minlength=n)
    short = (count > 0) & (count < WORDS)
    if short.any():
        first = np.searchsorted(doc, np.flatnonzero(short))
        whole = np.zeros(len(first), np.uint64)
        for k, odd in enumerate(powers(0xA0761D6478BD642F, WORDS)[1:]):
            inside = count[short] > k
            whole[inside] += mix64(h[first[inside] + k]) * odd
        s, owner = np.concatenate([s, mix64(whole)]), np.concatenate([owner, np.flatnonzero(short)])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    size = np.bincount(owner, minlength=n)
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix64(s + np.uint64(1)))])
    ends = np.cumsum(size)
    name = mix64(run[ends] - run[ends - size] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return name, size, s


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        name, size, _ = shingle_sets(batch)
        keys = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(name.view(np.int64)), pa.array(size.astype(np.int64))], [*keys, "class", "n_shingles"])


def needed(n: np.ndarray) -> np.ndarray:
    return -(-n * NUMERATOR // DENOMINATOR)


def _prefix(hashes: bytes, n: int, more: int, hot: np.ndarray) -> np.ndarray:
    """The first shingles of the common order that a partner must meet `more` times."""
    h = np.frombuffer(hashes, "<u8")
    h = h[np.lexsort((h, np.isin(h, hot)))]
    return h[: max(0, len(h) - int(needed(np.int64(n))) + more)]


def pair_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each pair of a prefix, and the place of the pair's second shingle."""
    i, j = np.triu_indices(len(h), 1)
    return mix64(np.minimum(h[i], h[j]) * np.uint64(0x9E3779B97F4A7C15) + mix64(np.maximum(h[i], h[j]))), j


def pieces(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in range(0, batch.num_rows, most):
            yield batch.slice(b, most)


def _costs(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each class its prefix's shingles with the level of its size."""
    for batch in pieces(batches):
        keys, level, pairs = [], [], []
        for x, n in zip(batch.column("hashes").to_pylist(), batch.column("n").to_pylist()):
            p = _prefix(x, n, 1, hot)
            keys.append(p)
            level.append(np.full(len(p), int(n).bit_length()))
            share = np.zeros(len(p))
            share[:1] = (len(p) + 1) * len(p) / 2
            pairs.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(level).astype(np.int32)), pa.array(np.concatenate(pairs))], ["key", "level", "pairs"])


def _keys(batches: Iterator[pa.RecordBatch], hot: np.ndarray, boundary: int) -> Iterator[pa.RecordBatch]:
    """Keys with most, the largest overlap with a partner whose first common shingle (or pair) is the key's."""
    for batch in pieces(batches):
        found, total = [], 0
        for i, (x, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hashes", "n", "m")))):
            if 1 < n <= boundary:
                keys, last = pair_keys(_prefix(x, n, 2, hot))
                found.append((i, keys, m - last + 1))
            # One shingle is the whole of what is common where sets have a single one.
            if n > boundary or n == 1 or 5 * n >= 4 * boundary:
                keys = _prefix(x, n, 1, hot)
                found.append((i, keys, m - np.arange(len(keys))))
            total += len(found[-1][1])
            if total > 500_000:
                yield _rows(batch, found)
                found, total = [], 0
        if found:
            yield _rows(batch, found)


def _rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    take = pa.array(np.repeat([i for i, _, _ in found], [len(k) for _, k, _ in found]).astype(np.int64))
    keys, most = np.concatenate([k for _, k, _ in found]).view(np.int64), np.concatenate([m for _, _, m in found]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(most), *(batch.column(c).take(take) for c in ("own", "n", "m"))], ["key", "most", "own", "n", "m"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y, n, k in zip(*(batch.column(c).to_pylist() for c in ("ha", "hb", "na", "nb"))):
            both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(DENOMINATOR * common >= NUMERATOR * (n + k - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of owners that are linked."""
    one, other = (sets.select(F.col("own").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").mapInArrow(_linked, "a long, b long, ok boolean")


def boundary_of(rows: list[tuple[int, float, float]]) -> int:
    """rows: level (bit length of a size), cost of enumeration, cost of lists -> the largest light size.

    Below the boundary classes enumerate, above it their lists are read.
    """
    best, at = sum(x[2] for x in rows), 1
    for level in sorted(x[0] for x in rows):
        cost = sum(x[1] if x[0] <= level else x[2] for x in rows)
        if cost < best:
            best, at = cost, (1 << level) - 1
    return at


def _verdicts(d: DataFrame, rows: bool) -> tuple[DataFrame, DataFrame]:
    """The rows without their texts, with class and n_shingles; and of each class its component (its smallest class) and the component's smallest doc_id.

    rows: each row is a document, else classes with the same smallest doc_id are one.
    """
    kinds = "".join(f"{c} long, " for c in d.columns if c != "text")
    members = written(d.mapInArrow(_members, f"{kinds}class long, n_shingles long"), "jaccard-members")
    d = d.select("doc_id", "text")
    classes = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    classes = written(classes, "jaccard-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared, hot = shared_hashes(d, shingle_sets, total, "jaccard-shared", FREQUENT)
    m = (F.octet_length("hashes") / 8).cast("long")
    # A partner of size s >= 0.8 n shares at least 4/9 (n + s) of the m, so m >= 0.8 n.
    sets = shared.join(classes, "class").withColumn("m", m).where("5 * m >= 4 * n").select(F.col("class").alias("own"), "n", "m", "hashes")
    sets = written(sets, "jaccard-sets")
    discard(shared)
    counts = sets.mapInArrow(partial(_costs, hot=hot), "key long, level int, pairs double").groupBy("key", "level").agg(F.count("*").alias("c"), F.sum("pairs").alias("pairs"))
    lists = counts.groupBy("key").agg(F.sum("c").alias("all"), F.collect_list(F.struct("level", "c", "pairs")).alias("by"))
    costs = lists.select("all", F.explode("by").alias("x")).groupBy("x.level").agg(F.sum("x.pairs").alias("pairs"), F.sum(F.col("x.c") * (1 + F.least(F.col("all") - 1, F.lit(PIVOTS)))).alias("lists")).collect()
    boundary = boundary_of([(r["level"], r["pairs"], float(r["lists"])) for r in costs])
    keys = sets.mapInArrow(partial(_keys, hot=hot, boundary=boundary), "key long, most long, own long, n long, m long")
    keys = written(keys, "jaccard-keys")

    fits = lambda x, y: (9 * F.least(f"{x}.most", f"{y}.most") >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))) & (5 * F.least(f"{x}.n", f"{y}.n") >= 4 * F.greatest(f"{x}.n", f"{y}.n"))
    ordered = lambda x, y: (F.least(f"{x}.own", f"{y}.own").alias("a"), F.greatest(f"{x}.own", f"{y}.own").alias("b"))
    whole = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("open"), "own", "n", "most")
    other = F.struct(F.xxhash64("own").alias("open"), "own", "n", "most")
    pivots = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(whole).alias("p"), F.min(other).alias("q")).where("c > 1")
    # Written, so that the join deals keys out by itself and a hot one can be split.
    pivots = written(pivots.select("key", F.explode(F.array("p", "q")).alias("p")).select("key", "p.own", "p.n", "p.most"), "jaccard-pivots")
    first = keys.alias("x").join(pivots.alias("y"), "key").where(fits("x", "y") & (F.col("x.own") != F.col("y.own"))).select(*ordered("x", "y")).distinct()
    tested = written(_compared(first, sets), "jaccard-tested")
    discard(pivots)
    found = components(tested.where("ok"), "a", "b")
    placed = keys.join(found.withColumnRenamed("node", "own"), "own", "left").withColumn("component", F.coalesce("component", "own"))
    placed = written(placed, "jaccard-placed")
    discard(keys, found)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = written(placed.join(mixed, "key"), "jaccard-left")
    discard(placed)
    rest = left.alias("x").join(left.alias("y"), "key").where((F.col("x.component") < F.col("y.component")) & fits("x", "y")).select(*ordered("x", "y")).distinct()
    rest = rest.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    late = written(_compared(rest, sets), "jaccard-late")
    discard(left, sets)
    known = classes.where("least IS NOT NULL")
    twice = known.groupBy("least").agg(F.min("class").alias("a"), F.count("*").alias("c")).where("c > 1").select("least", "a")
    one = twice.join(known, "least").where(F.col("class") != F.col("a")).select("a", F.col("class").alias("b"))
    edges = tested.where("ok").unionByName(late.where("ok")).select("a", "b")
    found = components(edges if rows else edges.unionByName(one), "a", "b")
    placed = written(classes.join(found.withColumnRenamed("node", "class"), "class", "left"), "jaccard-verdicts")
    discard(tested, late, classes, found)
    low = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("low"))
    placed = placed.withColumn("component", F.coalesce("component", "class")).join(low, "component", "left")
    return members, placed.select("class", "component", F.coalesce("low", "least").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id."""
    members, verdicts = _verdicts(two(docs), False)
    nothing = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.where("n_shingles > 0").join(verdicts, "class").select("doc_id", "n_shingles", "component_id").unionByName(nothing)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (null last), all columns; rows without words all stay.

    Each row is a document of its own, told apart by its place in the files of docs: of repeated rows one stays, rows of
    one doc_id with texts that aren't linked all stay, and a row without a doc_id stays where its group has no other.
    """
    rows = numbered(docs, "jaccard-rows")
    name = ["__file", "__row"]
    members, verdicts = _verdicts(rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["text"].cast("string").alias("text"), *name), True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *name)).alias("x")
    kept = members.where("n_shingles > 0").join(verdicts, "class").groupBy("component").agg(first).select("x.__file", "x.__row")
    kept = kept.unionByName(members.where("n_shingles = 0").select(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
