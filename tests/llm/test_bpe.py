import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factgraph.llm import bpe
from factgraph.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(doc_id, text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    back = LIBRARY.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def same(text):
    ids = bpe.coder(PATH).encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.coder(PATH).decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_encodes_as_the_library_does(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "\t", "\x1c", "\u0085", " ", "　", " ", "'s", "'LL", "12", "²", "Ⅷ", "é", "é", "ß", "日本", "\U0001f600", "!?", "--", "_", "\x00", "﻿", "<|endoftext|>", "<|endof", "a" * 9]), max_size=30).map("".join))
def test_mixed_pieces_encode_as_the_library_does(text):
    same(text)


def test_characters_of_every_kind_are_seen_as_the_library_sees_them():
    rng = random.Random(4)
    for _ in range(200):
        same("".join(rng.choice((chr(rng.choice((rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x33480)))), "a", "1", " ", "!")) for _ in range(25)))


def test_a_character_of_another_kind_in_the_pattern_engine(monkeypatch):
    coder = bpe.Bpe(PATH)
    monkeypatch.setattr(coder, "_kind", lambda c: 1 if c == "ж" else bpe.Bpe._kind(coder, c))
    coder._look_at("aж")
    assert coder.odd == {ord("ж"): bpe.STAND_INS[1]} and coder.pieces("aжx жж") == ["a", "ж", "x", " жж"]


def test_long_pieces_take_linear_work_and_special_strings_can_be_plain():
    for text in ("a" * 50_000, " " * 20_000, "ab" * 20_000 + "\n" * 5_000):
        same(text)
    plain = bpe.Bpe(PATH, special=False)
    assert plain.encode("x<|endoftext|>").tolist() != bpe.coder(PATH).encode("x<|endoftext|>").tolist()
    assert plain.decode(plain.encode("x<|endoftext|>")) == "x<|endoftext|>"
    assert plain.decode(plain.encode("é")[:1]) == "�" or len(plain.encode("é")) == 1


def test_each_prefix_has_one_last_token():
    coder = bpe.coder(PATH)
    v = coder.vocabulary
    for piece in (b" antidisestablishment", "Ünïcödé".encode(), b"aaaaaaa"):
        last = {0: None}
        for end in range(1, len(piece) + 1):
            fits = [t for i, t in v.tokens.iter(piece[:end].decode("latin-1")) if i == end - 1 and (end == v.length[t] or v.apart(last[end - v.length[t]], t))]
            assert len(fits) == 1
            last[end] = fits[0]


def test_full_caches_change_nothing(monkeypatch):
    for name in ("CACHE_CHUNKS", "CACHE_PIECES", "CACHE_PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    coder = bpe.Bpe(PATH)
    for text in ("one two three four, five's and 66 sevens\n\n  eight", "one  two"):
        assert coder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_small_vocabulary_whose_tokens_hide_each_other(tmp_path):
    """Merges ab, bc, abc by a+bc: 'abc' is never made from its text, as ab goes first."""
    vocab = {c: i for i, c in enumerate(bpe.byte_characters())} | {"ab": 256, "bc": 257, "abc": 258, "bcb": 259}
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"] |= {"vocab": vocab, "merges": [["a", "b"], ["b", "c"], ["a", "bc"], ["bc", "b"]]}
    spec["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    own, library = bpe.Bpe(str(path)), Tokenizer.from_file(str(path))
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    spec["normalizer"] = {"type": "NFC"}
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(path))


def test_operator_over_awkward_rows(spark, docs, texts, empty):
    assert sorted(tuple(r) for r in bpe.digests(docs, PATH).collect()) == sorted(expected(i, t) for i, t in texts.items())
    ids = {r.doc_id: r.ids for r in bpe.encoded(docs, PATH).collect()}
    assert all(LIBRARY.decode(ids[i]) == (t or "") for i, t in texts.items())
    rows = [(None, "null id"), (4, "x<|endoftext|> y"), (4, "x<|endoftext|> y"), (5, None)]
    got = [tuple(r) for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()]
    assert got == [expected(i, t) for i, t in rows]
    assert bpe.digests(empty, PATH).count() == 0


def test_query_over_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in QUERIES["op13_bpe"](spark, folder).collect()) == sorted(expected(*r) for r in rows)
