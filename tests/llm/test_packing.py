import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.brute import alike, awkward, fixture
from tessera.llm import packing
from tessera.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(rows, docs, slack):
    tok = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    total = 0
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(got.pop(doc_id), key=lambda r: r["piece"])
        for k, r in enumerate(mine):
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r["piece"], r["start"], r["length"]) == (k, 2048 * k, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert len(mine) == -(-len(ids) // 2048)
        total += len(ids)
    assert not got
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * (1 + slack) + 1


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    verify(packing.pack_documents(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 0.01)


def test_awkward_rows(spark):
    verify(packing.pack_documents(fixture(spark), PATH).collect(), [(i, t) for i, t, *_ in awkward()], 0.2)


def test_empty_table(spark):
    assert packing.pack_documents(fixture(spark, []), PATH).count() == 0


def test_runs_of_many_ids(spark):
    texts = ["before", "7" * ((1 << 20) + 7), "between 12 after", "7" * ((1 << 20) + 7) + " tail"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    verify(packing.pack_documents(fixture(spark, rows).coalesce(1), PATH).collect(), [(i, t) for i, t, *_ in rows], 0.2)


def test_runs_whose_hashes_agree(spark, monkeypatch):
    """Runs are told apart by their bytes, whatever the hash says."""
    monkeypatch.setattr(packing, "span_hash", lambda raw, b, e: (e - b).astype(np.uint64) & np.uint64(3))
    texts = [*alike(), " ".join(alike()), "to be or not to be, that is the question", "a ab abc abcd abce abcdefghijk abcdefghijl abcdefghijk", ""]
    tokenizer = packing.WordTokenizer(PATH)
    plain = Tokenizer.from_file(PATH)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for _ in range(2):
        ids, place = tokenizer(raw, at)
        assert [ids[b:e].tolist() for b, e in zip(place, place[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plans_hold_every_piece_once(histogram):
    runs = packing.plan(histogram, 64, 6, 8)
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, a, b, first, each, offset in runs:
        ranks[length].append((a, b))
        for k in range(b - a):
            bins[first + k // each].append((offset + k % each * length, length))
    for length, n in histogram.items():
        at = 0
        for a, b in sorted(ranks.pop(length)):
            assert a == at
            at = b
        assert at == n
    assert not ranks
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = -(-sum(n * c for n, c in histogram.items()) // 64)
    assert len(bins) <= 1.7 * max(total, sum(c for n, c in histogram.items() if n > 32)) + 7
