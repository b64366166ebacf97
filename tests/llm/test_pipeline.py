import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from factgraph.llm.tables import saved  # noqa: E402
from tests.llm.conftest import prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 documents: every tenth toxic, some near copies, some with a benchmark passage."""
    at = tmp_path_factory.mktemp("tables")
    bench = {i: prose(3000 + i, 30) for i in range(4)}
    rows = []
    for i in range(300):
        text = prose(i, 60)
        if i % 10 == 0:
            text += " vileword nastyword " + prose(i + 7000, 5)
        elif i % 10 == 3 and i > 100:
            text = prose(3, 60) if i % 20 == 3 else prose(3, 60) + " tail"
        elif i % 10 == 7 and i > 200:
            text += " " + bench[i % 4] + " " + prose(i + 8000, 5)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows.append((900, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 10 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, set(range(300)) | {900}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixture", "token_store"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = saved(stage(spark, docs, folder), name)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        gone = ids - left
        assert docs.columns == columns and left < ids
        if name == "toxicity":
            assert gone == {i for i in range(300) if i % 10 == 0}
        elif name == "ngram_jaccard_join":
            assert gone == {i for i in range(101, 300) if i % 10 == 3}
        else:
            assert gone == {i for i in range(201, 300) if i % 10 == 7}
        ids = left
    mixed = saved(corpus_pipeline.STAGES[3][1](spark, docs, folder), "mixed")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= ids
    assert all(len(r.text) == r.n_chars for r in mixed.collect())


def test_run_ends_in_token_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert rows and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(rows[0].asDict())
    # the ids of every text that the mix holds, as the encoder itself gives them
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = saved(stage(spark, docs, folder), "again")
    want = sorted((r.doc_id, zlib.crc32(np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == want


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    words = prose(5000, 200).split()
    block = [*words[:90], *(f"other{i}" for i in range(14)), *words[104:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(block)), (3, prose(5001, 200))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_rows_without_a_doc_id_and_repeated_ones_are_judged_by_themselves(spark, tmp_path):
    item = prose(9000, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, other = prose(9001, 60), prose(9002, 60)
    rows = [(1, f"{clean} {item}"), (None, f"{clean} {item}"), (1, other), (2, None), (3, ""), (None, prose(9003, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.contaminated(spark, docs, str(tmp_path)).collect()), key=repr)
    assert left == sorted(rows[2:], key=repr)
    copies = spark.createDataFrame([(7, clean), (None, clean), (5, clean), (5, clean), (5, other), (None, None), (None, None)], "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, copies, "").collect()), key=repr)
    assert left == sorted([(5, clean), (5, other), (None, None), (None, None)], key=repr)


def test_stages_keep_an_empty_table_and_other_columns(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0).selectExpr("*", "1 as row", "'x' as item_id")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, empty, folder)
        assert got.columns == empty.columns and got.count() == 0
