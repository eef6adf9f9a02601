"""LM scoring: stupid-backoff scores, computed relationally.

N-gram count tables, partitioned by the n-gram's hash, are joined to the documents' exploded n-grams: an n-gram counted at
least `least` times scores count / count of its context; else ALPHA times the score of the n-gram without its first word; a
single word scores count / number of words. A document's score is the mean of the logarithms. Counts cover all documents.

The rows of both tables travel packed. Documents are written in blocks of about `BLOCK_BYTES` of text. A block sends each of
its distinct n-grams once, with its own count, to the bucket of the hash, so a bucket gets an n-gram at most once from a block
however frequent it is; the bucket adds the counts and answers each block in the order asked. A block with its answers
then scores its documents alone. A message holds one n-gram or more, so there are never more rows than n-grams.
Contract of `score_documents`: one row per distinct doc_id (rows of one doc_id are one document); null, empty and blank
texts have no words and a null score; a null doc_id goes; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, mix64, partitions, trim, two, utf8, word_hashes, words_of, written

ORDER, LEAST, ALPHA = 3, 2, 0.4
BLOCK_BYTES = 6 << 20
BUCKET_GRAMS = 2_000_000
SPARE_BITS = 28
BLOCKS, MESSAGES = "block long, n_words long, data binary", "bucket int, block long, data binary"


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(words[0]), np.uint64(len(words)))
    for w in words:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _zipped(raw: bytes) -> bytes:
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _counts_out(n: np.ndarray) -> bytes:
    """A byte for each count; those of 255 or more stand in full behind."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def _counts_in(raw: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<u8", offset=size)
    return n


def _sorted_out(h: np.ndarray) -> bytes:
    """Ascending hashes as differences, by planes of bytes: the high planes, and the low ones of masked hashes, are nearly empty."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _sorted_in(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, 8 * size).reshape(8, size)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for batch in chunks(batches, BLOCK_BYTES):
        raw, at = utf8(batch.column("text"))
        n = len(words_of(raw, at)[0])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_words", "data"])
        k += 1


def _mask(grams: int) -> np.uint64:
    """Keeps the upper bits of a hash: two n-grams of `grams` share them by chance at most once in 2 ** SPARE_BITS, up to 2 ** 36 n-grams."""
    return np.uint64((1 << 64) - (1 << max(0, 64 - SPARE_BITS - grams.bit_length())))


def _exploded(data: bytes, order: int, mask: np.uint64) -> tuple[pa.Array, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a block: doc_ids, each word's document, each order's places and n-grams (that end there).

    A place is the number of the n-gram's last word in the block; no n-gram goes over the end of a document.
    """
    batch = pa.ipc.open_stream(data).read_next_batch()
    hashes, docs, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for piece in chunks(iter([batch])):  # hashing takes 40 bytes a byte: little at once
        raw, at = utf8(piece.column("text"))
        h, doc = word_hashes(LOWER[raw], at)
        hashes.append(h)
        docs.append(doc + start)
        start += piece.num_rows
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    places, grams = [], []
    for k in range(1, order + 1):
        if len(h) < k:
            places.append(np.zeros(0, np.int64))
            grams.append(np.zeros(0, np.uint64))
            continue
        inside = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
        places.append(inside + k - 1)
        grams.append(gram_hash([h[inside + j] for j in range(k)]) & mask)
    return batch.column("doc_id"), doc, places, grams


def _asked(batches: Iterator[pa.RecordBatch], order: int, buckets: int, mask: np.uint64) -> Iterator[pa.RecordBatch]:
    """Each block's distinct n-grams of all orders with their counts, a message to each bucket."""
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            found = [np.unique(g, return_counts=True) for g in _exploded(data, order, mask)[3]]
            h, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            by = np.argsort(h, kind="stable")
            h, n = h[by], n[by]
            to = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
            sent = [_zipped(np.uint64(e - b).tobytes() + _sorted_out(h[b:e]) + _counts_out(n[b:e])) for b, e in zip(cut, [*cut[1:], len(h)])]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.array([block] * len(cut), pa.int64()), pa.array(sent, pa.binary())], ["bucket", "block", "data"])
    trim()


def _answered(asked: pa.Table) -> pa.Table:
    """The count table of a bucket, joined to what the blocks asked: a count for each n-gram of each message, in its order."""
    hashes, counts = [], []
    for data in asked.column("data").to_pylist():
        raw = _unzipped(data)
        size = int.from_bytes(raw[:8], "little")
        hashes.append(_sorted_in(raw[8 : 8 + 8 * size], size))
        counts.append(_counts_in(raw[8 + 8 * size :], size))
    ends = np.cumsum([len(x) for x in hashes]).tolist()
    h, n = np.concatenate(hashes), np.concatenate(counts)
    del hashes, counts
    by = np.argsort(h, kind="stable")
    h = h[by]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(edge, len(h)))
    every = np.empty(len(h), np.int64)
    every[by] = np.repeat(np.add.reduceat(n[by], edge), size)
    out = [_zipped(np.uint64(e - b).tobytes() + _counts_out(every[b:e])) for b, e in zip([0, *ends[:-1]], ends)]
    return pa.table({"bucket": asked.column("bucket"), "block": asked.column("block"), "data": pa.array(out, pa.binary())})


def _scored(block: pa.Table, answers: pa.Table, order: int, least: int, alpha: float, total: int, mask: np.uint64) -> pa.Table:
    """doc_id, number of words and sum of log scores of each row of a block."""
    doc_id, doc, places, grams = _exploded(block.column("data")[0].as_py(), order, mask)
    found = [np.unique(g, return_inverse=True) for g in grams]
    h = np.concatenate([f[0] for f in found])
    told = [_unzipped(x) for x in answers.sort_by("bucket").column("data").to_pylist()]
    counts = np.empty(len(h), np.int64)
    if len(h):
        counts[np.argsort(h, kind="stable")] = np.concatenate([_counts_in(x[8:], int.from_bytes(x[:8], "little")) for x in told])
    score, of, start = np.zeros(len(doc)), np.zeros(len(doc), np.int64), 0
    for k, (own, inverse) in enumerate(found):
        n, at = counts[start : start + len(own)][inverse], places[k]
        start += len(own)
        hit = n >= (least if k else 1)
        score[at] += math.log(alpha) if k else 0.0  # backed off from this order, unless it counts
        score[at[hit]] = np.log(n[hit]) - (np.log(of[at[hit] - 1]) if k else math.log(max(total, 1)))
        of = np.zeros(len(doc), np.int64)
        of[at] = n
    missing = order - 1 - np.minimum(order - 1, np.arange(len(doc)) - np.searchsorted(doc, doc))
    score += missing * math.log(alpha)  # orders that a document's beginning is too short for
    return pa.table({"doc_id": doc_id, "n": np.bincount(doc, minlength=len(doc_id)).astype(np.int64), "s": np.bincount(doc, score, len(doc_id)).astype(np.float64)})


def score_documents(docs: DataFrame, order: int = ORDER, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words and score (mean of log scores, rounded to 6 places)."""
    spark = docs.sparkSession
    blocks = written(two(docs).where("doc_id is not null").mapInArrow(_blocks, BLOCKS), "backoff-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    mask = _mask(order * total)
    buckets = max(partitions(spark), -(-order * total // BUCKET_GRAMS))
    asked = blocks.select("block", "data").mapInArrow(partial(_asked, order=order, buckets=buckets, mask=mask), MESSAGES)
    answers = written(asked.groupBy("bucket").applyInArrow(_answered, MESSAGES), "backoff-counts")
    score = partial(_scored, order=order, least=least, alpha=alpha, total=total, mask=mask)
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    sums = both.applyInArrow(lambda b, a: score(b, a), "doc_id long, n long, s double")
    sums = sums.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("s").alias("s"))
    return sums.select("doc_id", "n_words", F.round(F.when(F.col("n_words") > 0, F.col("s") / F.col("n_words")), 6).alias("score"))


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] END AS b1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
  CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] END AS b2, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3 FROM p),
c AS (SELECT g, count(*) AS n FROM (SELECT g1 AS g FROM g UNION ALL SELECT g2 FROM g WHERE g2 IS NOT NULL UNION ALL SELECT g3 FROM g WHERE g3 IS NOT NULL) GROUP BY g),
total AS (SELECT count(*) AS n FROM p),
s AS (SELECT doc_id, CASE WHEN c3.n >= {LEAST} THEN ln(c3.n::DOUBLE / d2.n) WHEN c2.n >= {LEAST} THEN ln({ALPHA}::DOUBLE) + ln(c2.n::DOUBLE / d1.n) ELSE 2 * ln({ALPHA}::DOUBLE) + ln(c1.n::DOUBLE / total.n) END AS s
  FROM g CROSS JOIN total JOIN c c1 ON c1.g = g1 LEFT JOIN c c2 ON c2.g = g2 LEFT JOIN c c3 ON c3.g = g3 LEFT JOIN c d1 ON d1.g = b1 LEFT JOIN c d2 ON d2.g = b2)
SELECT doc_id, count(s) AS n_words, round(avg(s), 6) AS score FROM (SELECT doc_id, s FROM s UNION ALL SELECT doc_id, NULL FROM w) GROUP BY doc_id
"""
