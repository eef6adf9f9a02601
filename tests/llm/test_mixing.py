from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.brute import WORD, awkward, fixture
from tessera.llm import mixing
from tessera.llm.common import table


def check(rows, docs):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    goal = dict(zip(names, mixing.targets([total[s] for s in names])))
    assert len(rows) == len(docs)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 0.5 + 1e-6, s
    return goal


def test_whole_table(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
    rows = mixing.taken_words(d).collect()
    goal = check(rows, docs)
    assert abs(sum(goal.values()) - 1.5 * sum(r["size"] for r in rows)) < 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken_words(d.repartition(5)).collect()))


def test_awkward_rows(spark):
    check(mixing.taken_words(fixture(spark)).collect(), [(i, t, s) for i, t, _, s, _ in awkward()])


def test_empty_table(spark):
    assert mixing.taken_words(fixture(spark, [])).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, 200 / 3 * 0 + 250 / 3, 500 / 3] or abs(sum(mixing.targets([100, 100, 100])) - 450) < 1e-9
    assert mixing.targets([10, 1000]) [0] == 20
    assert mixing.targets([0, 0]) == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 700), st.floats(0, 2))
def test_slots_of_a_source_take_its_target(size, share):
    x = mixing.source_of(0, "s", size, share * size, 128)
    assert x.whole * 128 + x.part + x.turns * x.tail + x.extra == round(share * size)
    assert x.whole + (x.part > 0) <= 2 * x.full and x.turns + (x.extra > 0) <= 2 and x.extra < max(1, x.tail) and x.part < 128
    rows = []
    for shard, place, block, words in mixing_rows([x], 5):
        rows.append((block, words))
        assert words <= (128 if block < x.full else x.tail)
    assert sum(w for _, w in rows) == round(share * size) and len(rows) == x.quota
    assert all(n <= 2 for n in Counter(b for b, _ in rows).values())


def mixing_rows(sources, slots):
    import pyarrow as pa

    shards = -(-sum(x.quota for x in sources) // slots)
    tasks = pa.record_batch({"low": [0, shards // 2], "high": [shards // 2, shards]})
    return [tuple(r.values()) for b in mixing._slots(iter([tasks]), sources, slots, 7) for r in b.to_pylist()]


def test_draws_do_not_depend_on_tasks():
    quota = np.array([1000, 0, 37, 5, 1])
    shards = -(-int(quota.sum()) // 50)
    whole = list(mixing.draws(quota, 50, 3, range(shards)))
    assert [s for s, _, _ in whole] == list(range(shards))
    seen = np.zeros(5, np.int64)
    for _, first, count in whole:
        assert (first == seen).all() and count.sum() <= 50
        seen += count
    assert (seen == quota).all()
    for k in range(shards):
        (s, first, count), = mixing.draws(quota, 50, 3, range(k, k + 1))
        assert s == k and (first == whole[k][1]).all() and (count == whole[k][2]).all()


def test_small_sources_keep_their_words_together(spark):
    words = [f"w{i}" for i in range(7)]
    d = spark.createDataFrame([(1, " ".join(words), None, "a", None), (2, "x " * 3000, None, "b", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in mixing.mixed_documents(d).where("doc_id = 1").collect():
        assert r["text"].split() == words[: len(r["text"].split())]


def test_rows_without_doc_id_and_repeated_rows(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (1, "other words here"), (None, "no id at all"), (None, "no id at all"), (None, None), (2, "")]
    d = spark.createDataFrame([(i, t, None, s, None) for i, t in rows for s in ("a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter()
    for r in mixing.taken_words(d).collect():
        taken[r["doc_id"], r["source_size"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(d).collect():
        got[r["doc_id"], 19] += len(WORD.findall(r["text"]))
    assert sum(got.values()) == sum(taken.values()) == round(1.5 * 38)
    assert set(got) == {(1, 19), (None, 19)} and got == +taken


def test_permutation():
    for n in (1, 2, 3, 7, 100, 4097):
        k = np.arange(n)
        for seed in (1, 2):
            assert sorted(mixing.permuted(k, np.full(n, n), np.full(n, seed, np.uint64))) == list(range(n))


def test_mixed_documents_hold_what_is_taken(spark):
    d = fixture(spark)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(d).collect() if r["taken"]}
    got = mixing.mixed_documents(d).withColumn("n", F.regexp_count("text", F.lit(mixing.WORDS))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r["doc_id"]: r["n"] for r in got.collect()} == taken
