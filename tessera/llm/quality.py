"""Quality rules: gradient-boosted trees over document statistics.

The trees learn `labels.quality` from a bounded sample of labelled documents (`SAMPLE` rows with the smallest hashes of
doc_id, fold 2 left out); every document is scored. Repetition, symbols and duplicate lines may only lower a score.
Contract of `keep_documents`: one row per input row; null and empty texts have no words and fail the base rule; ties
and repeated rows repeat; without labels the score is the prior and the base rule alone decides; other columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, chunks, fold_of, mix64, powers, span_hash, two, utf8, words_of
from tessera.llm.gbt import Forest, fit

SAMPLE = 12000
KEEP = 0.4
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and their monotonic constraints.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "distinct_rate": 0,
    "upper_rate": 0, "digit_rate": 0, "punct_rate": 0, "bang_rate": -1, "words_per_line": 0, "long_words": 0,
    "top_word_rate": 0, "pipe_rate": 0, "non_ascii_rate": 0, "short_lines": 0,
}


def _flags(*spans: str | tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for s in spans:
        out[list(s.encode()) if isinstance(s, str) else range(s[0], s[1] + 1)] = 1
    return out


SYMBOL, UPPER, DIGIT, PUNCT, BANG, PIPE = _flags("#*$%&|<>"), _flags((65, 90)), _flags((48, 57)), _flags(".,;:!?\"'()-"), _flags("!?"), _flags("|")
LEADS, HIGH = 1 - _flags((0x80, 0xBF)), _flags((0xC0, 0xFF))


def sums(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text, the sum over its bytes."""
    run = np.concatenate([[0], np.cumsum(flag)])
    return run[at[1:]] - run[at[:-1]]


def repeated(words: np.ndarray, n: int = 5) -> int:
    """Words of one text that lie in windows of n words found twice or more. words: hashes."""
    if len(words) <= n:
        return 0
    mixed = mix64(words)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k, odd in enumerate(powers(0x9E6C63D0876A9A47, n)):
        h += mixed[k : k + len(h)] * odd
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def statistics(raw: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of the texts."""
    n = len(at) - 1
    b, e, doc = words_of(raw, at)
    h = span_hash(raw, b, e)
    first = np.searchsorted(doc, np.arange(n + 1))
    leads = np.concatenate([[0], np.cumsum(LEADS[raw])])
    chars = leads[e] - leads[b]
    in_words = np.concatenate([[0], np.cumsum(chars)])
    n_words = np.diff(first)
    word_chars = in_words[first[1:]] - in_words[first[:-1]]
    # Lines: split at \n; those with a word count as duplicates if equal to an earlier one of their text.
    newline = np.flatnonzero(raw == 10)
    inside = np.searchsorted(at, newline, "right") - 1
    owner = np.concatenate([np.arange(n), inside])
    starts, ends = np.concatenate([at[:-1], newline + 1]), np.concatenate([at[1:], newline])
    begins_first, ends_first = np.lexsort((starts, owner)), np.lexsort((ends, owner))
    starts, ends, owner = starts[begins_first], ends[ends_first], owner[begins_first]
    solid = np.concatenate([[0], np.cumsum(~SPACE[raw])])
    has_word = solid[ends] > solid[starts]
    lines = np.bincount(owner, has_word, n).astype(np.int64)
    lh = span_hash(raw, starts[has_word], ends[has_word])
    lo = owner[has_word]
    order = np.lexsort((lh, lo))
    same = (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    n_dup = np.bincount(lo[order][1:][same], minlength=n).astype(np.int64)
    n_repeat, distinct, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        own = h[first[i] : first[i + 1]]
        n_repeat[i] = repeated(own)
        if len(own):
            s = np.sort(own)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
    n_symbols = sums(SYMBOL[raw], at)
    size = np.maximum(1, np.diff(at))
    w = np.maximum(1, n_words)
    long = np.concatenate([[0], np.cumsum(chars > 14)])
    x = np.stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(1, lines), n_repeat / w, distinct / w,
        sums(UPPER[raw], at) / size, sums(DIGIT[raw], at) / size, sums(PUNCT[raw], at) / size, sums(BANG[raw], at) / w,
        n_words / np.maximum(1, lines), (long[first[1:]] - long[first[:-1]]) / w, top / w, sums(PIPE[raw], at) / w,
        sums(HIGH[raw], at) / size, lines / w,
    ], axis=1).reshape(n, len(FEATURES))
    return dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup, n_repeat))), x


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        _, x = statistics(*utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])


def _judged(batches: Iterator[pa.RecordBatch], forest: Forest, keep: float) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        base, x = statistics(*utf8(batch.column("text")))
        failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
        score = forest.probability(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(~failed & (score >= keep)), pa.array(np.round(score, 6))],
            ["doc_id", *BASE, "base_failed", "kept", "score"],
        )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """At most `sample` labelled rows come to the driver, as feature vectors."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(fold_of(F.col("doc_id")) != 2)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = two(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(_sampled, "quality double, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = rows["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows come in any order, sums of floats depend on it
    return fit(x[order], y[order], list(FEATURES.values()))


def keep_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score."""
    forest = learn(docs, labels, sample)
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, score double"
    return two(docs).mapInArrow(partial(_judged, forest=forest, keep=keep), schema)
