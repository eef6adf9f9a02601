"""The shared hash, against plain bytes."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import alike
from tessera.llm import common


def spans(words):
    raw = np.frombuffer(b" ".join(words), np.uint8)
    n = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(n + 1) - 1
    return raw, end - n, end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=60))
def test_equal_hashes_are_equal_bytes(words):
    raw, b, e = spans(words)
    h = common.span_hash(raw, b, e).tolist()
    assert [[x == y for y in h] for x in h] == [[x == y for y in words] for x in words]
    for k in range(len(words)):
        same = np.full(len(words), k)
        assert common.unlike(raw, b, e, same).tolist() == [w != words[k] for w in words]


def test_structured_words_have_hashes_of_their_own():
    for n in (8, 64, 1024, 4096, 1 << 16):
        raw, b, e = spans([w.encode() for w in (*alike(n), alike(n)[0])])
        h = common.span_hash(raw, b, e)
        assert h[0] != h[1] and h[0] == h[2]


def test_places_of_a_span_do_not_matter():
    rng = random.Random(1)
    word = bytes(rng.randrange(256) for _ in range(77))
    for n in range(78):
        raw = np.frombuffer(bytes(n) + word[:n] + b"x" + word[:n], np.uint8)
        h = common.span_hash(raw, np.array([n, 2 * n + 1]), np.array([2 * n, 3 * n + 1]))
        assert h[0] == h[1]
