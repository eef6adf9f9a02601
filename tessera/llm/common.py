"""Shared pieces: row names, byte-bounded Arrow chunks, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, partitions, table, written  # noqa: F401  for the operators here

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK_BYTES = 1 << 20


def two(docs: DataFrame) -> DataFrame:
    """Only doc_id and text: other columns never reach an operator, so their names can't clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with __file and __row, which together name a row in every read: what is no plain scan of Parquet is written first."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        docs = written(docs, name)
    return docs.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece take about `most` bytes; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    trim()


def trim() -> None:
    """Gives back to the system what a task has freed: workers are used again by the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLD = np.uint64(0x9E3779B97F4A7C15)
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, for a few terms."""
    return np.array([pow(base, k, 1 << 64) for k in range(n)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """raw[i : i + 8] as one number for every i, the end included; zeros follow the last byte."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def _further(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of more than 8 bytes; and of each lane of theirs after the first its span, its place in the span, its bytes' place."""
    long = np.flatnonzero(end - begin > 8)
    n = (end[long] - begin[long] - 1) >> 3
    which = np.repeat(np.arange(len(long)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + 1
    return long, which, k, begin[long][which] + 8 * k


def span_hash(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[b:e].

    Lanes of 8 bytes are mixed with their place in the span and added up. Each lane goes through the finaliser first, so
    that no structure of a text (as in Thue-Morse words, on which sums of powers modulo 2 ** 64 agree) cancels out.
    """
    eight, n = eights(raw), end - begin
    out = mix64((eight[begin] & KEEP[np.minimum(n, 8)]) + GOLD)
    long, which, k, at = _further(begin, end)
    if len(long):
        lanes = mix64((eight[at] & KEEP[np.minimum(end[long][which] - at, 8)]) + mix64(k.astype(np.uint64) * GOLD))
        out[long] += np.add.reduceat(lanes, np.flatnonzero(k == 1))
    return mix64(out ^ n.astype(np.uint64) * GOLD)


def unlike(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether each span differs in any byte from the span with the number `same` says."""
    eight, n = eights(raw), end - begin
    keep = KEEP[np.minimum(n, 8)]
    out = (n != n[same]) | ((eight[begin] ^ eight[begin[same]]) & keep != 0)
    alike = np.flatnonzero((n > 8) & ~out & (same != np.arange(len(n))))
    long, which, k, at = _further(begin[alike], end[alike])
    if len(long):
        own = alike[long][which]
        bad = (eight[at] ^ eight[begin[same[own]] + 8 * k]) & KEEP[np.minimum(end[own] - at, 8)] != 0
        out[own[bad]] = True
    return out


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each word [^\\x20\\x09-\\x0D]+, and never over the end of a text."""
    solid = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return b, e, np.searchsorted(at, b, "right") - 1


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and its text's number."""
    b, e, doc = words_of(raw, at)
    return span_hash(raw, b, e), doc


def window_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every n consecutive words of one text, and its text's number."""
    if len(h) < n:
        return h[:0], doc[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k, odd in enumerate(powers(0x9E6C63D0876A9A47, n)):
        out += mix64(h[k : len(h) - n + 1 + k]) * odd
    inside = doc[: len(out)] == doc[n - 1 :]
    return mix64(out[inside]), doc[: len(out)][inside]


def binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def fold_of(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4; fold 2 is held out everywhere."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
