"""Packed postings: which 48-bit hashes do two or more classes of equal texts share?

Each task packs the hashes of its classes by bucket of the hash; one shuffle brings a bucket together, a second one the
shared hashes of a class. A hash that a task meets in more than two classes is shared already: two of them go to the
bucket as witnesses, with the number, the others past it; so no bucket gets more than two postings of a hash from a
task. Hashes of many classes, at most `HOT` by the threshold's definition, are told to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, partitions, written

HOT = 500_000
MASK = np.uint64((1 << 48) - 1)
FLUSH = 1_200_000
PARTS = 4
TO_BUCKET, PAST, OTHER = 0, 1, 2


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & MASK) >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)


def six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8")[:, 0]


def pack(classes: np.ndarray, counts: np.ndarray, h: np.ndarray) -> bytes:
    """Hashes h of classes, so many each."""
    return np.uint32(len(classes)).tobytes() + classes.astype("<u8").tobytes() + counts.astype("<u4").tobytes() + six(h)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The class of each hash, and the hashes."""
    raw = np.frombuffer(data, np.uint8)
    n = int(raw[:4].view("<u4")[0])
    classes, counts = raw[4 : 4 + 8 * n].view("<u8"), raw[4 + 8 * n : 4 + 12 * n].view("<u4")
    h = unsix(raw[4 + 12 * n : 4 + 12 * n + 6 * int(counts.sum())])
    return np.repeat(classes, counts), h


def by_class(cls: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by class: classes, counts, hashes."""
    order = np.argsort(cls, kind="stable")
    cls, h = cls[order], h[order]
    edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
    return cls[edge], np.diff(np.append(edge, len(cls))), h


def split(to: np.ndarray, cls: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((cls, to))
    to, cls, h = to[order], cls[order], h[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    for b, e in zip(cut, [*cut[1:], len(to)]):
        yield int(to[b]), pack(*by_class(cls[b:e], h[b:e]))


ROWS = "bucket int, kind int, data binary"


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], ["bucket", "kind", "data"])


def _flush(classes: list, counts: list, hashes: list, buckets: int, salt: int) -> list[tuple[int, int, bytes]]:
    c, n, h = np.concatenate(classes).astype(np.uint64), np.concatenate(counts), np.concatenate(hashes) & MASK
    first = np.zeros(len(c), bool)
    first[np.unique(c, return_index=True)[1]] = True
    own, cls = np.repeat(first, n), np.repeat(c, n)
    cls, h = cls[own], h[own]
    order = np.argsort(h, kind="stable")
    cls, h = cls[order], h[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(h)))
    rank = np.arange(len(h)) - np.repeat(edge, size)
    many = size > 2
    witness = rank < 2
    out = [(b, TO_BUCKET, x) for b, x in split(bucket_of(h[witness], buckets), cls[witness], h[witness])]
    if (~witness).any():
        out.append((salt % buckets, PAST, pack(*by_class(cls[~witness], h[~witness]))))
        heavy, number = h[edge[many]], size[many]
        where = bucket_of(heavy, buckets)
        for b in np.unique(where):
            # A count travels as a class of its own kind: its number of classes beyond the two witnesses.
            out.append((int(b), OTHER, heavy[where == b].astype("<u8").tobytes() + (number[where == b] - 2).astype("<u8").tobytes()))
    return out


def _mapped(batches: Iterator[pa.RecordBatch], extract: Callable, buckets: int) -> Iterator[pa.RecordBatch]:
    classes, counts, hashes, total = [], [], [], 0
    salt = TaskContext.get().partitionId() * 7919
    for batch in chunks(batches):
        c, n, h = extract(batch)
        classes.append(c)
        counts.append(n)
        hashes.append(h)
        total += len(h)
        if total > FLUSH:
            yield rows(_flush(classes, counts, hashes, buckets, salt))
            classes, counts, hashes, total, salt = [], [], [], 0, salt + 1
    if classes:
        yield rows(_flush(classes, counts, hashes, buckets, salt))


def _twice(c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The postings (class, hash) of hashes that two classes or more have; and all hashes met twice with their numbers of classes."""
    if not len(x):
        return c, x, x, np.zeros(0, np.int64)
    order = np.argsort(x, kind="stable")
    c, x = c[order], x[order]
    edge = np.concatenate([[True], x[1:] != x[:-1], [True]])
    twice = ~(edge[1:] & edge[:-1])
    c, x = c[twice], x[twice]
    order = np.lexsort((c, x))
    c, x = c[order], x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    other = np.ones(len(x), bool)
    other[1:] = new[1:] | (c[1:] != c[:-1])
    c, x, new = c[other], x[other], new[other]
    size = np.diff(np.append(np.flatnonzero(new), len(x)))
    ok = np.repeat(size > 1, size)
    return c[ok], x[ok], x[new], size.astype(np.int64)


def _meet(table: pa.Table, buckets: int, hot: int) -> pa.Table:
    """Of a bucket, the postings of hashes with two classes or more, by bucket of the class; and the hot hashes."""
    cls, h, more_h, more_n, out = [], [], [], [], []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
        if kind == OTHER:
            x = np.frombuffer(data, "<u8").reshape(2, -1)
            more_h.append(x[0])
            more_n.append(x[1])
        else:
            c, x = unpack(data)
            if kind == PAST:
                out += [(b, PAST, y) for b, y in split(c % np.uint64(buckets), c, x)]
            else:
                cls.append(c)
                h.append(x)
    if h:
        c, x = np.concatenate(cls), np.concatenate(h)
        del cls, h
        mh, mn = (np.concatenate(y) if y else np.zeros(0, np.uint64) for y in (more_h, more_n))
        last, kept = x & np.uint64(PARTS - 1), []
        for part in range(PARTS):  # the sorts' copies are of a part of the bucket
            mine = last == part
            pc, px, heads, df = _twice(c[mine], x[mine])
            kept.append((pc, px))
            if len(mh) and len(heads):
                at = np.minimum(np.searchsorted(heads, mh), len(heads) - 1)
                good = heads[at] == mh
                np.add.at(df, at[good], mn[good].astype(np.int64))
            if (df >= hot).any():
                out.append((-1, OTHER, heads[df >= hot].astype("<u8").tobytes()))
        del c, x, last, mine, pc, px
        c, x = (np.concatenate([y[k] for y in kept]) for k in (0, 1))
        del kept
        out += [(b, PAST, y) for b, y in split(c % np.uint64(buckets), c, x)]
    return pa.Table.from_batches([rows(out)])


def _gathered(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    cls, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.lexsort((h, cls))
    cls, h = cls[order], h[order]
    new = np.ones(len(h), bool)  # copies in different tasks may bring a hash twice
    new[1:] = (cls[1:] != cls[:-1]) | (h[1:] != h[:-1])
    classes, counts, h = by_class(cls[new], h[new])
    ends = np.cumsum(counts)
    data = h.astype("<u8").tobytes()
    return pa.table({"class": pa.array(classes.view(np.int64)), "hashes": pa.array([data[8 * (e - n) : 8 * e] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())})


def shared_hashes(docs: DataFrame, extract: Callable, postings: int, name: str, least: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(class, its hashes that other classes have too), and the hot hashes: of at least `postings / HOT` and `least` classes.

    extract: a batch of docs -> classes, counts and hashes, where a class comes once or always with the same hashes.
    postings: about how many hashes there are.
    """
    n = max(partitions(docs.sparkSession), -(-postings // 2_000_000))
    hot = max(least, -(-postings // HOT))
    packed = docs.mapInArrow(partial(_mapped, extract=extract, buckets=n), ROWS)
    met = written(packed.groupBy("bucket").applyInArrow(lambda t: _meet(t, buckets=n, hot=hot), ROWS), name)
    often = [np.frombuffer(bytes(r["data"]), "<u8") for r in met.where(F.col("kind") == OTHER).select("data").collect()]
    shared = met.where(F.col("kind") == PAST).groupBy("bucket").applyInArrow(lambda t: _gathered(t), "class long, hashes binary")
    shared.written_to = met.written_to
    return shared, np.sort(np.concatenate(often)) if often else np.zeros(0, np.uint64)
