import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factgraph.llm import token_store
from factgraph.llm.pieces import BytePieces
from tests.llm.conftest import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50256), st.integers(0, 2**32 - 1), st.integers(7, 9)), max_size=700))
def test_pack_round_trip(values):
    ids = np.array(values, np.uint32)
    starts, body = token_store.pack(ids)
    assert (token_store.unpack(starts, body, len(ids)) == ids).all()
    assert int(starts[-1]) == len(body) and len(starts) - 1 == -(-len(ids) // token_store.BLOCK)


def test_shard_keeps_documents_apart():
    image = token_store.write_shard([3, None, 9], np.array([2, 1, 1]), np.array([5, 2, 2, 2], np.uint32))
    names, counts, ids = token_store.read_shard(image)
    assert names == [3, None, 9] and counts.tolist() == [2, 1, 1] and ids.tolist() == [5, 2, 2, 2]
    with pytest.raises(ValueError):
        token_store.read_shard(b"else" + image[4:])


def test_rows_equal_whole_text_encoding(docs, texts, spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = token_store.read(token_store.write(docs, PATH, 2, shard_tokens=200)).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(rows, sorted(texts.items()), strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \n\t,.'é  　日9|<>", max_size=60))
def test_pieces_encode_as_the_whole(text):
    import pyarrow as pa

    got = [ids.tolist() for _, ids, _ in token_store.encode_docs(PATH, 2, pa.array([text]))][0]
    assert got == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [2]


def test_words_that_meet_modulo_a_power_of_two_are_told_apart(spark):
    rows = list(enumerate(thue_morse()))
    tokenizer = Tokenizer.from_file(PATH)
    got = token_store.read(token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2)).orderBy("doc_id").collect()
    for r, (_, text) in zip(got, rows, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_pieces_of_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(BytePieces, "hashes", lambda self, data, begin, end: (end - begin).astype(np.uint64))
    tokenizer = Tokenizer.from_file(PATH)
    text = "there where these those, one two six ten.\n" * 3
    coder, data = BytePieces(PATH), np.frombuffer(text.encode(), np.uint8)
    for _ in range(2):
        assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_null_ids_repeated_rows_and_empty_table(spark, empty):
    docs = spark.createDataFrame([(None, "a"), (4, "b"), (4, "b")], "doc_id long, text string")
    rows = token_store.read(token_store.write(docs, PATH, 2)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 4, 4] and [r.start for r in rows] == [0, 2, 4]
    assert token_store.read(token_store.write(empty, PATH, 2)).count() == 0
