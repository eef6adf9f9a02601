import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import awkward, by_id, fixture
from tessera.llm import anchors, postings, repeats
from tessera.llm.common import table
from tessera.llm.suffixes import suffix_array


def brute(docs):
    """Per document: n_bytes, n_removed, n_spans, kept_sha256. doc_ids are distinct."""
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        edges = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[i] = (len(b), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def same(got, docs):
    want = brute(docs)
    assert set(got) == set(want)
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == w, i


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=80))
def test_suffix_array(t):
    assert suffix_array(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=5))
def test_progressions(groups):
    rows = [(g, x) for g, some in enumerate(groups) for x in sorted(some)]
    group, start = (np.array(c, np.int64) for c in zip(*rows))
    heads, stride, number = repeats.progressions(group, start)
    assert [(int(group[h]), int(start[h] + k * d)) for h, d, n in zip(heads, stride, number) for k in range(n)] == rows
    assert repeats.progressions(np.zeros(1000, np.int64), np.arange(1000) * 7)[2].tolist() == [1000]


def test_equal_windows_choose_equal_anchors():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab c") for _ in range(70)) for _ in range(4)]
    texts = ["".join(rng.choice(parts) for _ in range(6)).encode() for _ in range(30)] + [b"", b"x" * 49, b"y" * 200]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, h, first, last = anchors.chosen(raw, at)
    seen, covered = {}, 0
    for p, x, a, b in zip(place, h, first, last):
        for s in range(a, b + 1):
            covered += 1
            assert seen.setdefault(raw[s : s + 50].tobytes(), (p - s, x)) == (p - s, x)
    assert covered == sum(max(0, len(t) - 49) for t in texts)


def test_whole_table(spark, monkeypatch):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    same(by_id(repeats.removed_spans(d)), [(r["doc_id"], r["text"]) for r in d.collect()])


def test_hot_anchors_and_many_passages(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    docs = []
    for i in range(900):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        if i % 2:
            t = t[: len(t) // 2] + " " + passage[rng.randint(0, 60) :] + " " + t[len(t) // 2 :]
        if i % 7 == 0 and docs:
            t = docs[-1][1].replace("a", "b", 1) + t
        docs.append((i * 5 % 901, t))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(by_id(repeats.removed_spans(d)), docs)


def test_awkward_rows(spark):
    rows = awkward()
    same(by_id(repeats.removed_spans(fixture(spark))), [(i, t) for i, t, *_ in rows])
    assert repeats.removed_spans(fixture(spark, [])).count() == 0
    twice = fixture(spark, [*rows, rows[6]])
    assert repeats.removed_spans(twice).count() == len(rows) + 1


def test_sql(spark):
    rows = [(i, t) for i, t, *_ in awkward() if "\x00" not in (t or "")]
    docs = pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    con = duckdb.connect()
    con.register("documents", docs)
    got = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({repeats.ORACLE})").fetchall()}
    assert got == brute(rows)
    mine = by_id(repeats.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, r in mine.items()} == got


def test_postings_meet_in_parts():
    rng = np.random.default_rng(3)
    c, h = rng.integers(0, 40, 3000).astype(np.uint64), rng.integers(0, 900, 3000).astype(np.uint64)
    classes = {}
    for x, y in zip(c.tolist(), h.tolist()):
        classes.setdefault(y, set()).add(x)
    t = pa.Table.from_batches([postings.rows([(0, postings.TO_BUCKET, postings.pack(*postings.by_class(c, h)))])])
    found, often = set(), set()
    for kind, data in zip(*(postings._meet(t, 3, 6).column(k).to_pylist() for k in ("kind", "data"))):
        if kind == postings.OTHER:
            often |= set(np.frombuffer(data, "<u8").tolist())
        else:
            found |= {(int(y), int(x)) for x, y in zip(*postings.unpack(data))}
    assert found == {(y, x) for y, xs in classes.items() if len(xs) > 1 for x in xs}
    assert often == {y for y, xs in classes.items() if len(xs) >= 6}
    for one in (0, 1, 7):  # buckets with empty parts
        assert postings._meet(pa.Table.from_batches([postings.rows([(0, 0, postings.pack(np.uint64([1, 2]), np.array([1, 1]), np.uint64([one, one])))])]), 3, 6).num_rows


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    some = ["".join(rng.choice("abc d") for _ in range(90)) for _ in range(5)]
    texts = ["".join(rng.choice(some) for _ in range(40)) for _ in range(12)] + ["z" * 900, "z" * 300, "ab" * 500, "x" + "ab" * 300, "line of a log\n" * 90, "e" + "line of a log\n" * 70, "", "zé" * 400]
    docs = list(enumerate(texts))
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = {(p, s) for p, _, a, b in zip(*anchors.chosen(raw, at)) for s in range(a, b + 1)}
    for segment in (1, 64, 1000):
        cut = [(p, s) for x in anchors.runs_of(raw, at, segment) for p, _, a, b in zip(*x) for s in range(a, b + 1)]
        assert len(cut) == len(whole) and set(cut) == whole
    wait = repeats.runs_of
    monkeypatch.setattr(repeats, "runs_of", lambda raw, at: wait(raw, at, 700))
    same(by_id(repeats.removed_spans(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2))), docs)


def test_memory_of_texts_that_repeat_themselves():
    """20 MB of one letter, and of one line: all steps on the workers stay small."""
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert all(int(x) < 1500 for x in said.stdout.split()), said.stdout


LONG = """
import resource
from unittest import mock
import numpy as np
import pyarrow as pa
from tessera.llm import postings, repeats
for text in ("z" * 20_000_000, ("a line of a log, told again and again, with 60 letters.....\\n" * 340_000)[:20_000_000]):
    batch = lambda t, k: pa.record_batch({"class": pa.array([k]), "own": pa.array([k]), "text": pa.array([t])})
    both = [batch(text[:400], 1), batch(text, 2)]
    shared = set(repeats._anchors(both[0])[2].tolist()) & set(repeats._anchors(both[1])[2].tolist())
    hashes = pa.array([np.sort(np.array(list(shared), np.uint64)).tobytes()])
    sent = [x for b in both for x in repeats._contexts(iter([b.append_column("hashes", hashes)]), np.zeros(0, np.uint64), 1)]
    marks = repeats._sort(pa.Table.from_batches(sent), 1)
    found = repeats._gathered(marks)
    marked = dict(zip(found["class"].to_pylist(), found["marks"].to_pylist()))
    assert set(marked) == {2}
    begin, end = repeats.spans(marked[2])
    raw = np.frombuffer(text.encode(), np.uint8)
    assert (end - begin).sum() == len(raw) and repeats._kept(raw, begin, end) == b""
    print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_cut_documents(spark):
    rows = awkward()
    want = brute([(i, t) for i, t, *_ in rows])
    got = by_id(repeats.without_repeats(fixture(spark)))
    for i, t, *_ in rows:
        gone = want[i][1] and want[i][0] == want[i][1]
        assert (i not in got) == bool(gone)
        if not gone and want[i][1] == 0:
            assert got[i]["text"] == t


def test_cuts_take_whole_characters(spark):
    passage = "".join(f"w{i} " for i in range(30))
    rows = [(1, f"é{passage}ü tail"), (2, f"ĩ{passage}û other end"), (3, f"ũ{passage}ùx")]
    want = brute(rows)
    got = by_id(repeats.without_repeats(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")))
    assert got[2]["text"] == " other end" and got[3]["text"] == "x" and want[2][1] > len(passage)


def test_repeated_rows_of_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, a), (1, b), (2, a + b), (3, "x"), (3, "x"), (None, None), (None, None)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in repeats.without_repeats(d).collect())
    assert got == sorted([("1", a), ("1", a), ("1", b), ("3", "x"), ("3", "x"), ("None", "None"), ("None", "None")])


def test_rows_without_doc_id_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(5, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[0] + " and more words"), (None, "short"), (None, "")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in repeats.without_repeats(d).collect())
    assert got == sorted([("5", texts[0]), ("None", texts[1]), ("None", " and more words"), ("None", "short"), ("None", "")])
