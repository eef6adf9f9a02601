"""Pairs of prefixes, samples, splits and TF-IDF without tables of all pairs: the same rows as plain versions, and plans that deal out none."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, pairs, training
from tessera.sources import adapters, files
from tessera.storage import table, written

TRUTH = [("a1", "b1"), ("a2", "b1"), ("a9", "b2"), (None, "b3"), ("a1", "b1")]
ONE = [("a1", "Thea", "x", "en"), ("a2", "The b", "", "en"), ("a2", "THE b", "", "en"), ("a3", None, "x", "en"), ("a4", "Thea", "x", None), ("a5", "Theß", "y", "de"), (None, "Thea", "y", "en"), ("a6", "", "", "en")] + [(f"c{i}", f"Hot {i % 7}", "z", "fr") for i in range(40)]
TWO = [("b1", "THEa", "x", "en"), ("b1", "Thea", "x", "en"), ("b2", "The B", "x", "en"), ("b3", "Thea", None, "en"), ("b4", "Theß", "y", "de"), ("b5", None, "", "en"), ("b6", "", "", "en")] + [(f"d{i}", f"Hot {i % 5}", "z", "fr") for i in range(40)]


def draw(s, t):
    return hashlib.md5("|".join(x for x in (s, t, "42") if x is not None).encode()).hexdigest()


def sides(spark):
    return (spark.createDataFrame(TRUTH, "s1_id string, target_id string"), spark.createDataFrame(ONE, files.SOURCE), spark.createDataFrame(TWO, files.SOURCE))


def plain_negatives():
    known = set(TRUTH)
    return [(a[0], b[0], a[1], b[1]) for a in ONE for b in TWO if None not in (a[1], b[1], a[3], b[3]) and a[3] == b[3] and a[1][:3] == b[1][:3] and (a[0] is None or (a[0], b[0]) not in known)]


@pytest.mark.parametrize("part", [3, 2_000])
def test_negatives_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(training, "PART", part)
    got = training.negatives(*sides(spark))
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(plain_negatives())
    true = [(a, b) for a in ONE for b in TWO if a[0] and (a[0], b[0]) in TRUTH and a[3] == b[3] and (a[1] or "x")[:3] == (b[1] or "y")[:3]]
    assert training.near_count(*sides(spark)[1:]) == len(plain_negatives()) + len(true)


def test_no_pair_of_a_prefix_is_dealt_out(spark, sf):
    d = table(spark, sf, "documents")
    plan = training.negatives(training.exploded_truth(adapters.truth(d)), adapters.originals(d), adapters.changed(d))._jdf.queryExecution().optimizedPlan().toString()
    top = [re.sub(r"^[\s:+\-]*", "", x).split(" ")[0] for x in plan.splitlines()]
    assert "LeftAnti" not in plan and top.index("RepartitionByExpression") > top.index("Join")


def test_agreement_counts_what_pairs_have(spark):
    truth, one, two = sides(spark)
    want = Counter()
    for label, rows in ((1, training.positives(truth, one, two)), (0, training.negatives(truth, one, two))):
        for r in rows.collect():
            want[label, int(r["name1"] is not None and r["name2"] is not None and r["name1"].upper() == r["name2"].upper())] += 1
    assert {(r["label"], r["predicted"]): r["n"] for r in training.name_agreement(truth, one, two).collect()} == dict(want)


def test_sample_looks_at_small_draws_only(spark):
    d = spark.createDataFrame([(f"s{i}", f"t{i % 7}") for i in range(4000)], "s1_id string, target_id string")
    want = sorted((draw(*r), *r) for r in d.collect())
    for among in (None, 4000, 400, 400_000):
        assert sorted(tuple(r) for r in training.sampled(d, 50, among=among).collect()) == sorted(x[1:] for x in want[:50])
    assert training.sampled(d, 5000, among=4000).count() == 4000


@pytest.mark.parametrize("among", [None, 30, 1_000_000])
def test_split_by_the_place_of_its_cut(spark, among):
    rows = [(f"s{i}", f"t{i % 7}", int(i % 3 == 0), i) for i in range(900)] + [("same", "row", 2, i) for i in range(8)]
    d = spark.createDataFrame(rows, "s1_id string, target_id string, label int, other int")
    got = training.split(d, among=among).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    for label in (0, 1):
        own = sorted((draw(s, t), s, t, o) for s, t, x, o in rows if x == label)
        assert {r["other"] for r in got if r["label"] == label and r["held_out"]} == {x[3] for x in own[: round(0.2 * len(own))]}
    assert sum(r["held_out"] for r in got if r["label"] == 2) == 2


def plain_tfidf(one, two, top, min_df, max_df):
    def bag(name):
        words = re.sub(r"[^a-z0-9\s]", " ", (name or "").lower()).split()
        return Counter(f" {w} "[i : i + 3] for w in words for i in range(len(w)))

    out = set()
    for c in {r[3] for r in one if r[3]}:
        a, b = ([(r[0], bag(r[1])) for r in d if r[3] == c] for d in (one, two))
        df = Counter(g for _, x in a for g in x)
        idf = {g: math.log((1 + len(a)) / (1 + n)) + 1 for g, n in df.items() if min_df <= n <= max_df * len(a)}
        unit = lambda x: {g: n * idf[g] / math.sqrt(sum((m * idf[h]) ** 2 for h, m in x.items() if h in idf)) for g, n in x.items() if g in idf}
        a, b = ([(k, unit(x)) for k, x in d] for d in (a, b))
        for k, x in a:
            near = sorted((-round(sum(w * y.get(g, 0) for g, w in x.items()), 6), t) for t, y in b)
            out |= {(k, t, -s) for s, t in [z for z in near if z[0] < 0][:top]}
    return out


@pytest.mark.parametrize(("blocks", "min_df", "max_df"), [((7, 5), 1, 1.0), ((8_192, 16_384), 2, 0.8)])
def test_tfidf_of_distinct_names_in_blocks(spark, monkeypatch, blocks, min_df, max_df):
    monkeypatch.setattr(blocking, "BASE_BLOCK", blocks[0])
    monkeypatch.setattr(blocking, "TARGET_BLOCK", blocks[1])
    r = random.Random(1)
    name = lambda: " ".join(r.choice(("Ab", "abc", "cab-b", "dé", "b", "12 ab", "zz")) for _ in range(r.randint(0, 3)))
    one, two = ([(f"{k}{i}", name() if i % 9 else None, "", r.choice(("en", "fr", "", None))) for i in range(90)] for k in "ab")
    two += [(f"x{i}", "abc zz", "", "en") for i in range(30)]  # more copies than places
    want = plain_tfidf(one, two, 4, min_df, max_df)
    got = blocking.tfidf_candidates(*(spark.createDataFrame(x, files.SOURCE) for x in (one, two)), top=4, min_df=min_df, max_df=max_df)
    assert {tuple(x) for x in got.collect()} == want and want


def test_no_frequent_gram_makes_pairs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(blocking, "written", lambda df, name: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), written(df, name))[1])
    d = [(f"{i}", "abc", "", "en") for i in range(50)]
    got = blocking.tfidf_candidates(*(spark.createDataFrame(d, files.SOURCE) for _ in range(2)))
    assert got.count() == 50 * 15
    assert all(not re.search(r"Join Inner, \(g#", plan) for _, plan in seen) and "tfidf-names" in dict(seen)


def test_pairs_are_dealt_out_with_strings_only(spark, sf):
    d = table(spark, sf, "documents")
    a, b = adapters.source(d, 0), adapters.source(d, 1)
    found = a.select(F.col("entity_id").alias("s1_id")).join(b.select(F.col("entity_id").alias("target_id")))
    plan = pairs.native_features(pairs.hydrate_described(found, a, b), "s2")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(plan) if "Join" in x]
    made = [i for i, x in enumerate(plan) if "Generate explode(array(" in x]
    assert any(i < joins[0] for i in made)  # the base record is described above the last join


def test_everywhere_meets_other_countries(spark, monkeypatch):
    monkeypatch.setattr(blocking, "BASE_BLOCK", 3)
    monkeypatch.setattr(blocking, "TARGET_BLOCK", 4)
    one, two = ([(f"{k}{i}", f"abc {'xy' if i % 3 else 'zz'} {i % 4}", "", c) for i in range(20)] for k, c in (("a", "en"), ("b", "fr")))
    want = plain_tfidf(*([(*r[:3], "*") for r in d] for d in (one, two)), 15, 2, 0.8)
    got = blocking.tfidf_candidates(*(blocking.everywhere(spark.createDataFrame(d, files.SOURCE)) for d in (one, two)), min_df=2, max_df=0.8)
    assert {tuple(x) for x in got.collect()} == want and want
    assert not got._jdf.queryExecution().optimizedPlan().toString().count("wa#")


def test_blocks_meet_without_copies(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(blocking, "written", lambda df, name: (seen.update({name: df}), written(df, name))[1])
    monkeypatch.setattr(blocking, "BASE_BLOCK", 6)
    monkeypatch.setattr(blocking, "TARGET_BLOCK", 5)
    one, two = ([(f"{k}{i}", f"ab{i % 50} c{i % 7} same", "", "*") for i in range(60)] for k in "ab")
    got = blocking.tfidf_candidates(*(spark.createDataFrame(d, files.SOURCE) for d in (one, two)), top=3)
    want = plain_tfidf(one, two, 3, 1, 1.0)
    assert {tuple(x) for x in got.collect()} == want and len(want) == 180
    plan = seen["tfidf-names"]._jdf.queryExecution()
    top = [re.sub(r"^[\s:+\-]*", "", x).split(" ")[0] for x in plan.optimizedPlan().toString().splitlines()]
    assert "FlatMapCoGroupsInArrow" not in top and not {"RepartitionByExpression", "Generate"} & {*top[: top.index("Join")]}
    assert "CartesianProduct" in plan.executedPlan().toString()
    assert seen["tfidf-names"].count() <= 60 * 3  # best of all blocks, not of each
