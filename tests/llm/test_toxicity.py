from factgraph.llm import toxicity
from tests.llm.conftest import prose

BAD = ("vileword", "nastyword", "crudeword")


def make(spark, n):
    rows = [(i, prose(i, 50) + (f" {BAD[i % 3]}{'x' * (i % 2)} " + prose(i + 9000, 20) if i % 6 == 0 else "")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_chain_catches_toxic_and_keeps_clean(spark):
    docs = make(spark, 500)
    labels = spark.createDataFrame([(i, int(i % 12 > 0), int(i % 6 == 0)) for i in range(360)] + [(4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert [m is not None for m in chain.models][0] and len(chain.models) == len(toxicity.CATEGORIES)
    got = {r.doc_id: r for r in toxicity.assess(docs, chain).collect()}
    held = range(360, 500)
    assert all(0 <= r[c] <= 1 for r in got.values() for c in toxicity.CATEGORIES)
    assert sum(got[i].rejected for i in held if i % 6 == 0) >= 0.9 * sum(i % 6 == 0 for i in held)
    assert sum(got[i].rejected for i in held if i % 6) == 0


def test_one_class_nulls_and_empty(spark, docs, texts, empty):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None
    assert toxicity.train(empty, labels) is None
    rows = toxicity.assess(docs, None).collect()
    assert len(rows) == len(texts) and not any(r.rejected for r in rows)
    assert toxicity.assess(empty, None).count() == 0
