import random
from collections import defaultdict

from tests.llm.brute import alike, awkward, by_id, fixture
from tessera.llm import jaccard
from tessera.llm.common import table

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    seen = set()
    for same in lists.values():
        for j in range(len(same)):
            for k in range(j):
                pair = (same[k], same[j])
                if pair not in seen:
                    seen.add(pair)
                    a, b = (sets[x] for x in pair)
                    if 100 * len(a & b) >= 80 * len(a | b):
                        x, y = sorted((find(pair[0]), find(pair[1])))
                        up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def same(got, docs):
    want = brute(docs)
    assert set(got) == set(want)
    for i, (n, c) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (n, c), i


def test_whole_table(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    same(by_id(jaccard.near_duplicates(d)), [(r["doc_id"], r["text"]) for r in d.collect()])


def test_groups_of_near_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    docs, passage = [], [rng.choice(vocabulary) for _ in range(30)]
    for size in (300, 60, 24, 12, 8, 7, 6, 5, 4, 3, 2, 1):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[: max(1, len(t) - rng.randint(0, size // 6 + 1))]
            if rng.random() < 0.2:
                t = passage + t
            docs.append(" ".join(t))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    same(by_id(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))), docs)


def test_every_boundary(spark, monkeypatch):
    rng = random.Random(12)
    docs = []
    for _ in range(60):
        base = [f"v{rng.randrange(200)}" for _ in range(rng.randint(1, 50))]
        for _ in range(3):
            t = list(base)
            t[rng.randrange(len(t))] = "x"
            docs.append(" ".join(t if rng.random() < 0.5 else base + ["y"] * rng.randint(0, 3)))
    docs = list(enumerate(docs))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for boundary in (1, 15, 1000):
        monkeypatch.setattr(jaccard, "boundary_of", lambda rows: boundary)
        same(by_id(jaccard.near_duplicates(d)), docs)


def test_awkward_rows(spark):
    rows = awkward()
    same(by_id(jaccard.near_duplicates(fixture(spark))), [(i, t) for i, t, *_ in rows])
    assert jaccard.near_duplicates(fixture(spark, [])).count() == 0
    kept = jaccard.without_near_duplicates(fixture(spark))
    want = {i for i, (_, c) in brute([(i, t) for i, t, *_ in rows]).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == fixture(spark).columns


def test_rows_without_doc_id(spark):
    words = [f"n{i}" for i in range(60)]
    near, other, lone = " ".join(words), " ".join(f"o{i}" for i in range(60)), " ".join(f"l{i}" for i in range(60))
    rows = [(5, near + " tail"), (7, lone), (None, near), (None, other), (None, other), (None, other + " tail"), (None, lone), (None, "unlike all of the others here"), (None, ""), (None, None)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.near_duplicates(d).collect())
    want = [(5, 57, 5), (7, 56, 7), (0, 56, 5), (0, 56, 0), (0, 56, 0), (0, 57, 0), (0, 56, 7), (0, 2, 0), (0, 0, 0), (0, 0, 0)]
    assert got == sorted(want)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.without_near_duplicates(d).collect()]
    others = [x for x in kept if x[1] and x[1].startswith(other)]
    assert len(others) == 1
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[1], others[0], *rows[7:]]))


def test_repeated_rows_in_a_stage(spark):
    words = [f"n{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"o{i}" for i in range(60))
    rows = [(4, near), (4, near), (4, other), (3, near + " tail"), (9, other), (5, ""), (5, ""), (None, other)]
    d = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard.without_near_duplicates(d).collect())
    assert kept == sorted([(3, near + " tail"), (4, other), (5, ""), (5, "")])


def test_words_of_structured_letters(spark):
    base = " ".join(f"b{i}" for i in range(4))
    docs = [(i, f"{base} {w}") for i, w in enumerate((*alike(), alike()[0]))]
    same(by_id(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))), docs)
