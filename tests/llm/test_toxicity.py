import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.brute import awkward, by_id, fixture
from tessera.llm import toxicity
from tessera.llm.common import table

LEXICON = toxicity.Lexicon({"stupid": 3.0, "disgusting": 3.0, "scum": 3.0}, {"lowei": 4.0})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["stupid", "disgusting", "scum"]), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("dxsi"), st.sampled_from("abstu")), max_size=3))
def test_automaton_equals_distances(word, changes):
    for at, what, ch in changes:
        at = min(at, len(word))
        word = word[:at] + ("" if what == "d" else ch) + word[at + (what in "dx") :]
    near = {t for t in LEXICON.words if distance(word, t) <= toxicity.edits(t)}
    assert (LEXICON.fuzzy(word) in near) if near else LEXICON.fuzzy(word) is None


def test_matches():
    assert LEXICON.match("Stupid,")[0] == toxicity.EXACT
    assert LEXICON.match("stupd!")[0] == toxicity.FUZZY
    assert LEXICON.match("5tup1d") is not None
    assert LEXICON.match("loweihr")[0] == toxicity.STEM
    assert LEXICON.match("student") is None


def rows(*texts):
    return [dict(zip(toxicity.FEATURES, r)) for r in toxicity.features(pa.array(texts, pa.string()), LEXICON)]


def test_quotation_and_windows():
    plain, said, long, open_, german, alone, after = rows(
        "x you are stupid", 'x he said "stupid" then', '"you are such a total stupid one today" was the phrase', '"you are such a total stupid one today', "„du bist so stupid heute“ war das Wort", '" you are stupid " was it', '"a quotation" and you are stupid'
    )
    assert plain["window"] > said["window"] > 0 and plain["quoted_share"] == 0
    for x in (said, long, german, alone):
        assert x["quoted_share"] == 1, x
    assert long["window"] < open_["window"] and open_["quoted_share"] == after["quoted_share"] == 0


def test_batches_do_not_matter():
    texts = [None, "", *(t for _, t, *_ in awkward()), "stupid", 'a "b c stupid d" e stupid', "don't be stupid, it's 'scum' you know"]
    assert rows(*texts) == [rows(t)[0] for t in texts]


def test_long_words():
    term = "donaudampfschifffahrtsgesellschaft"
    lexicon = toxicity.Lexicon({term: 3.0}, {})
    assert lexicon.match(term)[0] == toxicity.EXACT and lexicon.match(term[:20] + "x" + term[21:])[0] == toxicity.FUZZY
    assert lexicon.match(term + "xyz") is None and lexicon.match("z" * 100_000) is None


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = toxicity.score_documents(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.8 and c.get((0, 1), 0) / c[0, 0] < 0.02


def test_awkward_rows_and_empty_tables(spark, sf):
    labels = table(spark, sf, "labels")
    got = by_id(toxicity.score_documents(fixture(spark), labels))
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert toxicity.score_documents(fixture(spark), labels.limit(0)).count() == len(awkward())
    assert toxicity.score_documents(fixture(spark, []), labels).count() == 0


def test_filter_keeps_columns(spark, sf):
    d = table(spark, sf, "documents")
    kept = toxicity.clean_documents(d, table(spark, sf, "labels"))
    scored = toxicity.score_documents(d, table(spark, sf, "labels")).where("predicted = 0")
    assert kept.columns == d.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in scored.select("doc_id").collect()}
