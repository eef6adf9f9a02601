"""Suffix-array dedup: repeated strings of 50 bytes across documents, by difference-cover suffix sorting.

1. Equal texts are one class with its smallest doc_id; copies of a class lose all that its 50-byte strings cover.
2. Winnowed anchors (see anchors): equal strings choose equal anchors, so only windows whose anchor two classes share
   can be repeated. Packed postings find the shared anchors.
3. The bytes around shared anchors meet by anchor (windows of very frequent anchors by their own bytes, which splits hot
   groups); equal contexts are one, and those of one document travel as one with the progressions (start, stride, number)
   of their places. Each batch of contexts is sorted by the difference-cover algorithm: sampled triples sorted and named,
   names sorted recursively, the remaining suffixes merged; then adjacent suffixes' first 50 bytes are compared, and the
   smallest doc_id of an equal run marks the others.
4. Marks meet by class, and the text is cut.
Contract of `removed_spans` and `without_repeats`: one row per input row; null and empty texts are 0 bytes with nothing
removed; copies (ties) keep the one with the smallest doc_id, and rows of that very doc_id all stay; a null doc_id is
after all others, and rows with a null doc_id cut nothing from each other; an empty table gives no rows; other columns are
dropped (without_repeats keeps lang and source). Very long texts are read in pieces of `SEGMENT` windows; memory goes
with their length, not with how often they repeat themselves. Classes are named by 64-bit hashes of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import WINDOW, runs_of
from tessera.llm.common import chunks, discard, partitions, span_hash, utf8, written
from tessera.llm.postings import MASK, OTHER, PAST, TO_BUCKET, bucket_of, rows, shared_hashes, six, unsix
from tessera.llm.suffixes import equal_prefixes, suffix_array

BATCH = 1_000_000
PIECE = 1 << 20
FREQUENT = 4096
LAST = (1 << 63) - 1


def _anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, at = utf8(batch.column("text"))
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for _, h, start, _ in runs_of(raw, at):
        doc, h = _distinct(np.searchsorted(at, start, "right") - 1, h & MASK)
        docs.append(doc)
        hashes.append(h)
    doc, h = _distinct(np.concatenate(docs), np.concatenate(hashes))
    return batch.column("class").to_numpy().view(np.uint64), np.bincount(doc, minlength=batch.num_rows), h


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def progressions(group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of group and start, cut into runs of one group and one stride: the runs' first rows, strides, numbers."""
    gap = np.diff(start, prepend=0)
    first = np.ones(len(start), bool)
    first[1:] = group[1:] != group[:-1]
    turn = np.ones(len(start), bool)
    turn[1:] = (gap[1:] != gap[:-1]) & ~first[:-1]  # the second row of a group only sets the stride
    heads = np.flatnonzero(first | turn)
    number = np.diff(np.append(heads, len(start)))
    return heads, np.where(number > 1, gap[np.minimum(heads + 1, len(start) - 1)], 0), number


FIELDS = (("key", 6, None), ("own", 8, "<i8"), ("class", 8, "<u8"), ("size", 4, "<u4"), ("runs", 4, "<u4"))


def _pack_contexts(key: np.ndarray, own: np.ndarray, cls: np.ndarray, size: np.ndarray, runs: np.ndarray, places: np.ndarray, data: bytes) -> bytes:
    """places: rows (start, stride, number), `runs` of them for each context."""
    return np.uint32(len(key)).tobytes() + six(key) + own.astype("<i8").tobytes() + cls.astype("<u8").tobytes() + size.astype("<u4").tobytes() + runs.astype("<u4").tobytes() + places.astype("<u4").tobytes() + data


def _unpack_contexts(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n, at, out = int(raw[:4].view("<u4")[0]), 4, []
    for _, width, kind in FIELDS:
        part = raw[at : at + width * n]
        out.append(unsix(part) if kind is None else part.view(kind).astype(np.int64 if kind != "<u8" else np.uint64))
        at += width * n
    end = at + 12 * int(out[-1].sum())
    return [*out, raw[at:end].view("<u4").reshape(-1, 3).astype(np.int64), raw[end:]]


def _pack_marks(cls: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    return cls.astype("<u8").tobytes() + start.astype("<u4").tobytes() + n.astype("<u4").tobytes()


def _spread(cls: np.ndarray, places: np.ndarray, shift: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of n windows from `shift` on at all of each row's places: one where they cover the bytes between, else one each."""
    start, stride, number = places[:, 0] + shift, places[:, 1], places[:, 2]
    whole = stride < n + WINDOW
    n = np.where(whole, n + stride * (number - 1), n)
    times = np.where(whole, 1, number)
    which = np.repeat(np.arange(len(n)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return cls[which], start[which] + step * stride[which], n[which]


def _by_bucket(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[order], prepend=to[order][:1] - 1)) if len(to) else []
    for b, e in zip(cut, [*cut[1:], len(to)]):
        yield int(to[order[b]]), order[b:e]


def ranges(size: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`; one row is never cut."""
    ends, b = np.cumsum(size), 0
    while b < len(size):
        e = max(b + 1, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + most, "right")))
        yield b, e
        b = e


def gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[b : b + n] of all pairs, one after the other; in pieces, as the places take 24 times the room of bytes."""
    out, at = np.empty((int(size.sum()), *raw.shape[1:]), raw.dtype), 0
    for b, e in ranges(size):
        n = size[b:e]
        ends = np.cumsum(n)
        where = np.repeat(begin[b:e] - (ends - n), n) + np.arange(int(n.sum()))
        out[at : at + len(where)] = raw[where]
        at += len(where)
    return out


def _marks(cls: np.ndarray, start: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(b, PAST, _pack_marks(cls[i], start[i], n[i])) for b, i in _by_bucket((cls % np.uint64(buckets)).astype(np.int64))]


def _contexts(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts by bucket of their key; of equal ones of a task the first document's alone, the others are marked here."""
    held: list[list[np.ndarray]] = []
    lost: list[tuple[int, int, bytes]] = []
    total = 0
    for batch in chunks(batches, 1 << 18):
        raw, at = utf8(batch.column("text"))
        own, cls = batch.column("own").to_numpy(), batch.column("class").to_numpy().view(np.uint64)
        shared = [np.frombuffer(x, "<u8") for x in batch.column("hashes").to_pylist()]
        # (document, hash) pairs as rows of a set: both lists are sorted by document.
        sdoc, sh = np.repeat(np.arange(len(shared)), [len(x) for x in shared]), np.concatenate(shared) if shared else np.zeros(0, np.uint64)
        known = np.sort(span_pairs(sdoc, sh))
        for _, h, first, last in runs_of(raw, at):
            h = h & MASK
            doc = np.searchsorted(at, first, "right") - 1
            mine = span_pairs(doc, h)
            at_known = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            ok = known[at_known] == mine if len(known) else np.zeros(len(mine), bool)
            h, first, last, doc = h[ok], first[ok], last[ok], doc[ok]
            is_hot = np.isin(h, hot)
            n = np.where(is_hot, last - first + 1, 1)
            which = np.repeat(np.arange(len(h)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            begin = first[which] + step
            size = np.where(is_hot[which], WINDOW, last[which] - begin + WINDOW)
            doc = doc[which]
            content = span_hash(raw, begin, begin + size)
            key = np.where(is_hot[which], content & MASK, h[which])
            # Equal contexts of a document are one; of those of several documents the first one's is sent, the others are marked here.
            start = begin - at[doc]
            order = np.lexsort((start, cls[doc], own[doc], content, key))
            k, c, d = key[order], content[order], doc[order]
            new = np.ones(len(order), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (cls[d[1:]] != cls[d[:-1]])
            group = np.cumsum(new) - 1
            heads, stride, number = progressions(group, start[order])
            places = np.stack([start[order][heads], stride, number], axis=1)
            runs = np.bincount(group[heads], minlength=int(new.sum()))
            i = order[new]
            parts = [key[i], content[i], own[doc[i]], cls[doc[i]], size[i], runs, places, gather(raw, begin[i], size[i])]
            parts, gone = _first_owners(parts)
            lost += _marks(*gone, buckets)
            held.append(parts)
            total += len(parts[7]) + 50 * len(parts[0]) + 12 * len(parts[6]) + 16 * len(gone[0])
            if total > 12_000_000:
                yield rows(lost + _send(held, buckets))
                held, lost, total = [], [], 0
    if held:
        yield rows(lost + _send(held, buckets))


def _first_owners(parts: list[np.ndarray]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The contexts that no equal one of an earlier document is among, and the marks of the others."""
    key, content, own, cls, size, runs, places, data = parts
    order, group, least = _leaders(key, content, own)
    later = np.zeros(len(key), bool)
    later[order] = own[order] > least[group]
    row = np.repeat(np.arange(len(key)), runs)
    out = later[row]
    gone = _spread(cls[row[out]], places[out], np.zeros(int(out.sum()), np.int64), size[row[out]] - WINDOW + 1)
    place, left = np.cumsum(size) - size, ~later
    return [key[left], content[left], own[left], cls[left], size[left], runs[left], places[~out], gather(data, place[left], size[left])], gone


def span_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each (text number below 2 ** 16, 48-bit hash)."""
    return a.astype(np.uint64) << np.uint64(48) | b


def _leaders(key: np.ndarray, content: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, content and owner; the number of the group of each row, and each group's smallest owner."""
    order = np.lexsort((own, content, key))
    k, c = key[order], content[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, np.cumsum(new) - 1, own[order][new]


def _send(held: list[list[np.ndarray]], buckets: int) -> list[tuple[int, int, bytes]]:
    (key, _, own, cls, size, runs, places, data), gone = _first_owners([np.concatenate([x[k] for x in held]) for k in range(8)])
    out = _marks(*gone, buckets)
    place, at = np.cumsum(size) - size, np.cumsum(runs) - runs
    for b, i in _by_bucket(bucket_of(key, buckets).astype(np.int64)):
        out.append((b, TO_BUCKET, _pack_contexts(key[i], own[i], cls[i], size[i], runs[i], gather(places, at[i], runs[i]), gather(data, place[i], size[i]).tobytes())))
    return out


def _sorted_batch(raw: np.ndarray, place: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For every window of distinct contexts (in order) the smallest owner of an equal window."""
    ends = place + size
    window = np.ones(len(raw), bool)
    outs = (np.repeat(ends, WINDOW - 1) - np.tile(np.arange(1, WINDOW), len(ends)))
    window[outs] = False
    order = suffix_array(raw.astype(np.int64) + 1)
    order = order[window[order]]
    group = np.cumsum(~equal_prefixes(raw, order, WINDOW)) - 1
    owner = own[np.searchsorted(place, order, "right") - 1]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, LAST)
    np.minimum.at(least, group, owner)
    out = np.full(len(raw), LAST)
    out[order] = least[group]
    return out


def _sort(table: pa.Table, buckets: int) -> pa.Table:
    kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
    out = [(b, PAST, x) for b, k, x in zip(table.column("bucket").to_pylist(), kinds, data) if k == PAST]
    parts = [_unpack_contexts(x) for k, x in zip(kinds, data) if k == TO_BUCKET]
    if parts:
        key, own, cls, size, runs, places, raw = (np.concatenate([p[k] for p in parts]) for k in range(7))
        del parts
        place, at = np.cumsum(size) - size, np.cumsum(runs) - runs

        def mark(i: np.ndarray, shift: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes]]:
            """Marks of n windows from `shift` on in the contexts i, at all their places."""
            return _marks(*_spread(np.repeat(cls[i], runs[i]), gather(places, at[i], runs[i]), np.repeat(shift, runs[i]), np.repeat(n, runs[i])), buckets)

        content = span_hash(raw, place, place + size)
        order, group, least = _leaders(key, content, own)
        head = order[np.flatnonzero(np.diff(group, prepend=-1))]  # one context of each content
        hk = key[head]
        alone = np.ones(len(head), bool)
        alone[1:] &= hk[1:] != hk[:-1]
        alone[:-1] &= hk[1:] != hk[:-1]
        # A content alone with its key: its windows' smallest owner is its own. The others go through the sort, by key.
        todo = np.flatnonzero(~alone)
        filled = np.cumsum(size[head[todo]])
        edge = np.ones(len(todo) + 1, bool)
        edge[1:-1] = hk[todo][1:] != hk[todo][:-1]
        cuts, goal = [0], BATCH
        for i in np.flatnonzero(edge)[1:].tolist():
            if filled[i - 1] >= goal or i == len(todo):
                cuts.append(i)
                goal = filled[i - 1] + BATCH
        where, result = np.full(len(head), -1), []
        base = 0
        for b, e in zip(cuts, cuts[1:]):
            i = todo[b:e]
            n = size[head[i]]
            text = gather(raw, place[head[i]], n)
            begin = np.cumsum(n) - n
            result.append(_sorted_batch(text, begin, n, least[i]))
            where[i] = base + begin
            base += len(text)
        lows = np.concatenate(result) if result else np.zeros(0, np.int64)
        row_group, n = group, size[order] - WINDOW + 1
        simple = where[row_group] < 0
        gone = simple & (own[order] > least[row_group])
        lost = order[gone]
        out += mark(lost, np.zeros(len(lost), np.int64), n[gone])
        hard = np.flatnonzero(~simple)
        for b, e in ranges(n[hard]):
            some = hard[b:e]
            m = n[some]
            which = np.repeat(some, m)
            step = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
            bad = own[order][which] > lows[where[row_group[which]] + step]
            which, step = which[bad], step[bad]
            if len(which):
                new = np.ones(len(which), bool)
                new[1:] = (which[1:] != which[:-1]) | (step[1:] != step[:-1] + 1)
                head_at = np.flatnonzero(new)
                out += mark(order[which[head_at]], step[head_at], np.diff(np.append(head_at, len(which))))
    return pa.Table.from_batches([rows(out)])


def _gathered(table: pa.Table) -> pa.Table:
    cls, start, n = [], [], []
    for x in table.column("data").to_pylist():
        k = len(x) // 16
        cls.append(np.frombuffer(x, "<u8", k))
        start.append(np.frombuffer(x, "<u4", k, 8 * k))
        n.append(np.frombuffer(x, "<u4", k, 12 * k))
    c, s, m = (np.concatenate(x) for x in (cls, start, n))
    order = np.lexsort((s, c))
    c, s, m = c[order], s[order], m[order]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(c))
    return pa.table({"class": pa.array(c[edge].view(np.int64)), "marks": pa.array([s[b:e].tobytes() + m[b:e].tobytes() for b, e in zip(edge.tolist(), ends.tolist())], pa.binary())})


def spans(marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the marked windows cover."""
    k = len(marks) // 8
    start = np.frombuffer(marks, "<u4", k).astype(np.int64)
    end = start + np.frombuffer(marks, "<u4", k, 4 * k) + WINDOW - 1
    if not k:
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, k - 1)]


def _kept(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    step = np.zeros(len(raw) + 1, np.int8)
    step[begin] += 1
    step[end] -= 1
    return raw[np.cumsum(step[:-1], dtype=np.int8) == 0].tobytes()


def _to_characters(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts widened to whole characters of UTF-8."""
    inner = np.append(raw & 0xC0 == 0x80, False)  # bytes that go on with a character
    begin, end = begin.copy(), end.copy()
    for _ in range(3):
        begin -= inner[begin]
        end += inner[end]
    return begin, end


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw, at = utf8(batch.column("text"))
        found = []
        for i, marks in enumerate(batch.column("marks").to_pylist()):
            b, e = spans(marks)
            own = raw[at[i] : at[i + 1]]
            text = _kept(own, *_to_characters(own, b, e)).decode() if texts else None
            found.append((int((e - b).sum()), len(b), hashlib.sha256(_kept(own, b, e)).hexdigest(), text))
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string()), pa.array([x[3] for x in found], pa.string())], ["class", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _verdicts(docs: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, class, n_bytes, sha256) of all documents; and of each class its owner and, if cut, its verdict."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("class", F.xxhash64("text"))
    info = written(d.select("doc_id", "class", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "repeats-info")
    owners = written(info.groupBy("class").agg(F.min("doc_id").alias("own")), "repeats-owners")
    total = info.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shared, hot = shared_hashes(d.where(F.octet_length("text") >= WINDOW), _anchors, total // 13, "repeats-shared", FREQUENT)
    mine = shared.join(owners, "class").withColumnRenamed("own", "doc_id").withColumnRenamed("class", "its")
    marked = d.join(mine, "doc_id").where("class = its").select("class", F.col("doc_id").alias("own"), "text", "hashes")
    marked = written(marked, "repeats-texts")
    discard(shared)
    n = max(partitions(spark), -(-total // 4_000_000))
    sent = marked.mapInArrow(partial(_contexts, hot=hot, buckets=n), "bucket int, kind int, data binary")
    marks = sent.groupBy("bucket").applyInArrow(lambda t: _sort(t, buckets=n), "bucket int, kind int, data binary")
    marks = written(marks.groupBy("bucket").applyInArrow(lambda t: _gathered(t), "class long, marks binary"), "repeats-marks")
    cut = marked.select("class", "text").join(marks, "class").mapInArrow(partial(_cut, texts=texts), "class long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    one = cut.groupBy("class").agg(*(F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept_text")))
    verdicts = written(owners.join(one, "class", "left"), "repeats-verdicts")
    discard(marked, marks, owners)
    return info, verdicts


NOTHING = hashlib.sha256(b"").hexdigest()


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    info, verdicts = _verdicts(docs, False)
    copy = (F.col("doc_id") > F.col("own")) & (F.col("n_bytes") >= WINDOW)
    return info.join(verdicts, "class").select(
        F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, NOTHING).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeated spans cut out, widened to whole characters; those of which nothing is left go.

    Rows find their verdict by their text's class, so that repeated rows and rows without a doc_id get theirs each once.
    """
    _, verdicts = _verdicts(docs, True)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), "lang", "source", F.xxhash64(text).alias("class"), docs["text"].isNull().alias("missing")).join(verdicts, "class")
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("own")) & (F.octet_length("text") >= WINDOW)
    d = d.select("doc_id", "lang", "source", (F.col("text") == "").alias("blank"), F.when(copy, "").otherwise(F.coalesce("kept_text", "text")).alias("text"), "missing")
    return d.where("text <> '' or blank").select("doc_id", F.when(~F.col("missing"), F.col("text")).alias("text"), "lang", "source", F.length("text").cast("long").alias("n_chars"))


# Texts as hexadecimal digits, so that places are those of bytes; windows are taken from pieces of 128, as places in long strings cost DuckDB time.
ORACLE = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, j, substr(h, 2 * j + 1, 354) AS piece FROM (SELECT doc_id, h, unnest(range(0, n - 49, 128)) AS j FROM d WHERE n >= 50)),
w AS (SELECT doc_id, j + k AS i, substr(piece, 2 * k + 1, 100) AS s FROM (SELECT doc_id, j, piece, unnest(range(length(piece) // 2 - 49)) AS k FROM t)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, i > coalesce(max(i) OVER p + 50, -1) AS new FROM w JOIN f USING (s) WHERE doc_id > least WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT doc_id, k, min(i) AS b, max(i) + 50 AS e FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY ALL),
x AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS was FROM r),
c AS (SELECT doc_id, sum(e - b)::BIGINT AS gone, count(*) AS spans, string_agg(substr(h, 2 * was + 1, 2 * (b - was)), '' ORDER BY b) AS kept, max(e) AS last FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
