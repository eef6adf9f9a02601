import math
import re
from collections import Counter

from tests.llm.brute import awkward, by_id, fixture
from tessera.llm import backoff
from tessera.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, order=3, least=2, alpha=0.4):
    split = {i: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in docs}
    counts = Counter(tuple(w[j : j + k]) for w in split.values() for k in range(1, order + 1) for j in range(len(w) - k + 1))
    total = sum(map(len, split.values()))
    out = {}
    for i, w in split.items():
        s = 0.0
        for j in range(len(w)):
            for k in range(order, 0, -1):
                g = tuple(w[j - k + 1 : j + 1]) if j - k + 1 >= 0 else ()
                if g and (k == 1 or counts[g] >= least):
                    s += math.log(counts[g] / (counts[g[:-1]] if k > 1 else total)) + (order - k) * math.log(alpha)
                    break
        out[i] = (len(w), s / len(w) if w else None)
    return out


def same(got, docs):
    want = brute(docs)
    assert set(got) == set(want)
    for i, (n, s) in want.items():
        assert got[i]["n_words"] == n and (got[i]["score"] is None if s is None else abs(got[i]["score"] - s) < 2e-6), i


def test_whole_table(spark, sf):
    d = table(spark, sf, "documents")
    same(by_id(backoff.score_documents(d)), [(r["doc_id"], r["text"]) for r in d.collect()])


def test_awkward_rows(spark):
    same(by_id(backoff.score_documents(fixture(spark))), [(i, t) for i, t, *_ in awkward()])
    assert backoff.score_documents(fixture(spark, [])).count() == 0
