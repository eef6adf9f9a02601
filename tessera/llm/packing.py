"""Best-fit packing by linear grouping (after Fernandez de la Vega and Lueker).

Documents become token pieces of at most `CAPACITY`. Only the histogram of piece lengths, at most CAPACITY rows, comes
to the driver. There long lengths are sorted and dealt into groups of equal cardinality, each rounded up to its
longest; column generation finds configurations of these few sizes; actual pieces take the configurations' slots, and
left-over and short pieces go best-fit into what room the actual lengths leave. The result is a table of runs (length,
ranks, first sequence, pieces per sequence, offset) whose size depends on the number of lengths only; each piece finds
its run by its length and its rank among the pieces of its length.
Contract of `pack_documents`: every token of every row is in one piece; null and empty texts have the separator alone;
repeated rows are packed each; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, span_hash, two, unlike, utf8, words_of, written

CAPACITY, GROUPS, SMALL, SEPARATOR = 2048, 400, 682, 0

class WordTokenizer:
    """A tokenizer with the ids of the runs of its texts kept by the runs' bytes.

    It never joins over white space or where an ASCII letter meets an ASCII sign, as its own pattern parts letters
    from signs (save the apostrophe, which begins contractions), and it lower-cases; so a text is the sequence of such
    runs, lower-cased. Texts with a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.runs: dict[bytes, int] = {}  # run -> place in the pool << 31 | number of ids, as a text has less than 2^31 bytes
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0

    def _add(self, runs: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), len(self.pool)), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], ends[:-1]])
        self.runs.update(zip(runs, (self.used + begins << 31 | ends - begins).tolist()))
        self.used += len(ids)

    def _learn(self, runs: list[bytes]) -> None:
        """Letters are encoded as one text and cut at the ids that end a word, all else by itself."""
        letters, other = [], []
        for run in runs:
            (letters if run.decode().isalpha() else other).append(run)
        for b in range(0, len(letters), 2000):
            some = letters[b : b + 2000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._add(some, ids, ends)
            else:
                other += some
        if other:
            each = [e.ids for e in self.tokenizer.encode_batch([x.decode() for x in other], add_special_tokens=False)]
            self._add(other, np.array([i for ids in each for i in ids], "<u4"), np.cumsum([len(ids) for ids in each]))

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        if len(self.runs) > KNOWN_RUNS:
            self._clear()
        raw = LOWER[raw]
        b, e, _ = words_of(raw, at)
        kind = KIND[raw]
        meet = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1  # a letter beside a sign
        meet = meet[~np.isin(meet, at)]
        b, e = np.sort(np.concatenate([b, meet])), np.sort(np.concatenate([e, meet]))
        _, first, which = np.unique(span_hash(raw, b, e), return_index=True, return_inverse=True)
        odd = np.flatnonzero(unlike(raw, b, e, first[which]))  # other bytes with a run's hash: a run each
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        data = raw.tobytes()
        runs = [data[x:y] for x, y in zip(b[first].tolist(), e[first].tolist())]
        if new := {x for x in runs if x not in self.runs}:
            self._learn(list(new))
        found = np.array([self.runs[x] for x in runs], np.int64)
        found = found[which]
        n = found & (1 << 31) - 1
        ends = np.cumsum(n)
        ids = self.pool[np.repeat((found >> 31) - (ends - n), n) + np.arange(n.sum())]
        return ids, np.concatenate([[0], ends])[np.searchsorted(b, at)]


KNOWN_RUNS, KEPT_RUNS = 600_000, 400_000  # within a task, and from task to task
SIGNS = ".,!?;:*#$%&|<>()-\""
KIND = np.zeros(256, np.uint8)
KIND[97:123] = 1
KIND[list(SIGNS.encode())] = 2
_tokenizers: dict[str, WordTokenizer] = {}


def tokenized(texts: pa.Array, path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    own = _tokenizers[path]
    raw, at = utf8(texts)
    ids, place = own(raw, at)
    data, place = ids.tobytes(), (4 * place).tolist()
    out = [data[b:e] for b, e in zip(place, place[1:])]
    lower = LOWER[raw].tobytes()
    for word in own.special:
        if word in lower:
            for i, t in enumerate(texts.to_pylist()):
                if t and word.decode() in t.lower():
                    out[i] = np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, cut int, rank long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(capacity + 1, np.int64)
    cut = TaskContext.get().partitionId()
    for batch in chunks(batches, 2 << 20):
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenized(batch.column("text"), path)):
            ids += SEPARATOR.to_bytes(4, "little")
            for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[b : b + 4 * capacity]
                n = len(part) // 4
                rows.append((doc_id, k, k * capacity, n, zlib.crc32(part), cut, int(seen[n])))
                seen[n] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], PIECES.replace(",", "").split()[::2])
    if path in _tokenizers and len(_tokenizers[path].runs) > KEPT_RUNS:
        _tokenizers[path]._clear()  # later stages share this worker's memory


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations with their numbers, never over the demand: column generation, then rounding down."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    most = capacity // min(sizes)
    x = need / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        # The best configuration at these prices: best[t][c] with t pieces in room c.
        best, came = np.zeros(capacity + 1), []
        for _t in range(most):
            step, by = best.copy(), np.full(capacity + 1, -1)
            for j, s in enumerate(sizes):
                if price[j] > 1e-12:
                    got = best[:-s] + price[j]
                    better = got > step[s:] + 1e-12
                    step[s:][better], by[s:][better] = got[better], j
            came.append(by)
            if (by < 0).all():
                break
            best = step
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for by in reversed(came):
            if by[room] >= 0:
                column[by[room]] += 1
                room -= sizes[by[room]]
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * way
        x[out] = ratio[out]
        basis[:, out] = column
        x = np.maximum(x, 0)
    left, found = np.array(demand, np.int64), []
    for j in np.argsort(-x):
        column = basis[:, j].astype(np.int64)
        if (column > 0).any():
            n = min(int(x[j] + 1e-6), int((left[column > 0] // column[column > 0]).min()))
            if n > 0:
                left -= n * column
                found.append((tuple(column.tolist()), n))
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, rank after the last, first sequence, pieces per sequence, offset)."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    rooms: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, number)
    order: list[int] = []  # the free rooms, ascending
    sequences = 0

    def free(room: int, first: int, n: int) -> None:
        if n and room:
            if not rooms.get(room):
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((first, n))

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    if full := histogram.get(capacity, 0):
        put(capacity, full, 0, 1, 0)
        sequences = full
    big = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if small < n < capacity and histogram[n]]
    total = sum(c for _, c in big)
    dealt: list[list[list[int]]] = []  # of each group: lengths with counts, longest first
    if total:
        share, room = -(-total // groups) if len(big) > groups else 1 + max(c for _, c in big), 0
        for n, c in big:
            room *= len(big) > groups  # few lengths are groups of their own
            while c:
                if not room or n < 0.9 * dealt[-1][0][0]:  # rounding up never adds over a ninth
                    dealt.append([])
                    room = share
                take = min(c, room)
                dealt[-1].append([n, take])
                c, room = c - take, room - take
        merged: dict[int, int] = {}  # rounded length -> group, as equal ones are one size
        sizes, demand, members = [], [], []
        for g in dealt:
            top = g[0][0]
            if top not in merged:
                merged[top] = len(sizes)
                sizes.append(top)
                demand.append(0)
                members.append([])
            demand[merged[top]] += sum(c for _, c in g)
            members[merged[top]].extend(g)
        for column, n in configurations(sizes, demand, capacity):
            segments = [(sequences, n, 0)]  # first sequence, number, tokens in each
            sequences += n
            for j, slots in enumerate(column):
                for _ in range(slots):
                    after = []
                    for first, m, filled in segments:
                        while m:
                            item = members[j][0]
                            take = min(m, item[1])
                            put(item[0], take, first, 1, filled)
                            after.append((first, take, filled + item[0]))
                            first, m = first + take, m - take
                            item[1] -= take
                            if not item[1]:
                                members[j].pop(0)
                    segments = after
            for first, m, filled in segments:
                free(capacity - filled, first, m)
    for length in sorted(histogram, reverse=True):
        rest = histogram[length] - used[length]
        while rest:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                n = -(-rest // (capacity // length))
                free(capacity, sequences, n)
                sequences += n
                continue
            room = order[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            each = room // length
            whole = min(n, rest // each)
            if whole:
                put(length, whole * each, first, each, capacity - room)
                free(room - each * length, first, whole)
                rest -= whole * each
            if whole < n and rest:
                put(length, rest, first + whole, rest, capacity - room)
                free(room - rest * length, first + whole, 1)
                rest, whole = 0, whole + 1
            free(room, first + whole, n - whole)
    return runs


def _placed(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = runs[:, 0] << 44 | runs[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        run = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
        k = rank - run[:, 1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    found = written(two(docs).mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity), PIECES), "packing-pieces")
    counts = found.groupBy("length", "cut").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("cut")) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    ranked = found.join(counts.drop("n"), ["length", "cut"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(partial(_placed, runs=runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
