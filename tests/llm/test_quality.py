import numpy as np

from tests.llm.brute import awkward, base_counts, by_id, fixture
from tessera.llm import gbt, quality
from tessera.llm.common import table


def test_base_counts_on_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = by_id(quality.keep_documents(docs, table(spark, sf, "labels")))
    for r in docs.collect():
        assert tuple(got[r["doc_id"]][k] for k in quality.BASE) == base_counts(r["text"])


def test_awkward_rows(spark, sf):
    got = by_id(quality.keep_documents(fixture(spark), table(spark, sf, "labels")))
    assert len(got) == len(awkward())
    for i, text, *_ in awkward():
        n, *rest = base_counts(text)
        assert tuple(got[i][k] for k in quality.BASE) == (n, *rest)
        assert got[i]["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_empty_tables(spark, sf):
    labels = table(spark, sf, "labels")
    assert quality.keep_documents(fixture(spark, []), labels).count() == 0
    assert quality.keep_documents(fixture(spark), labels.limit(0)).count() == len(awkward())


def test_monotone_and_flattened():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - np.sin(3 * x[:, 1]) + rng.normal(size=3000) > 0).astype(float)
    f = gbt.fit(x, y, [1, 0, 0])
    assert ((f.margin(x) > 0) == y).mean() > 0.75
    grid = np.column_stack([np.linspace(-3, 3, 50), np.zeros(50), np.zeros(50)])
    for b in np.linspace(-2, 2, 9):
        grid[:, 1] = b
        assert (np.diff(f.margin(grid)) >= -1e-12).all()


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import fold_of

    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = quality.keep_documents(table(spark, sf, "documents"), labels)
    r = got.join(labels.where(fold_of(F.col("doc_id")) == 2), "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert r > 0.9
