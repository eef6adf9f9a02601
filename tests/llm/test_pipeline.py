from collections import defaultdict

from tests.llm import test_jaccard, test_packing, test_repeats
from tests.llm.brute import WORD
from tessera.llm import mixing, toxicity
from tessera.llm.common import table, written


def test_stages_against_plain_versions(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), f"test-{name}"))
    assert all(set(d.columns) == set(names) for d in seen[:-1])
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:4]]
    scored = toxicity.score_documents(docs, table(spark, sf, "labels"))
    assert set(rows[1]) == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    groups = test_jaccard.brute(list(rows[1].items()))
    assert set(rows[2]) == {i for i, (_, c) in groups.items() if i == c}
    cut = test_repeats.brute(list(rows[2].items()))
    assert set(rows[3]) == {i for i, (n, gone, *_) in cut.items() if not n or gone < n}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(seen[3]).collect()}
    got = defaultdict(int)
    for r in seen[4].collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {i: n for i, n in taken.items() if n} == dict(got)
    pieces = seen[5].collect()
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["piece"] == 0 for r in pieces) == seen[4].count()


def test_rows_are_kept_apart(spark, sf):
    """Rows without a doc_id and rows that share one: no stage loses or multiplies them."""
    import corpus_pipeline

    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (2, texts[0] + " tail"), (3, "short one"), (3, "other one"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    some = lambda d: sorted((str(r["doc_id"]), str(r["text"])) for r in d.collect())
    assert some(stages["toxicity"](spark, docs, sf)) == sorted((str(i), t or "") for i, t in rows)
    kept = written(stages["ngram_jaccard_join"](spark, docs, sf), "test-kept")
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (3, "short one"), (3, "other one"), (None, ""), (4, "")]
    assert some(kept) == sorted((str(i), t) for i, t in want)
    cut = written(stages["suffix_array_dedup"](spark, kept, sf), "test-cut")
    assert some(cut) == some(kept)
    mixed = stages["mixing_sources"](spark, cut, sf)
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == round(1.5 * (4 * 30 + 4))
    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    assert len(packed) == len(rows) and sorted(str(r["doc_id"]) for r in packed) == sorted(str(i) for i, _ in rows)


def test_empty_table(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-empty")
    assert docs.count() == 0
