import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factgraph.llm import alignment
from factgraph.llm.bpe import byte_characters
from factgraph.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
CODE = {c: b for b, c in enumerate(byte_characters())}


def groups_of(text):
    """Groups of one text by sets of byte offsets, or none."""
    if not text:
        return []
    a, b = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, LIBRARY_B.encode(text, num_threads=1)
    parts_a = [bytes(CODE[c] for c in LIBRARY_A.id_to_token(i)) for i in a]
    parts_b = [bytes([int(p[3:-1], 16)]) if LIBRARY_B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [LIBRARY_B.id_to_piece(i)]]
    if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
        return []
    ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b)]
    out, last = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(([i for i, e in zip(a, ends[0], strict=True) if last < e <= cut], [i for i, e in zip(b, ends[1], strict=True) if last < e <= cut]))
        last = cut
    return out


def expected(rows):
    """Rows of all documents by dictionaries of links."""
    grouped = [groups_of(t) for _, t in rows]
    links = [[(a, b) for g in groups for a in g[0] for b in g[1]] for groups in grouped]
    held = Counter(pair for found in links for pair in set(found))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc_id, _), groups, found in zip(rows, grouped, links, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(found), sum(held[p] == top[p[0]] for p in found), sum(held[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


WORDS = ["the", "ing", "Straße", " ", "  ", "   ", "\n", "\t ", "日本語", "\U0001f600", "▁", "<s>", "<|endoftext|>", "<0x0A>", "é", " ", "\x00", "x.y", "!!", "12 345"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.lists(st.sampled_from(WORDS), max_size=12).map("".join)), min_size=1, max_size=4))
def test_slices_equal_brute_force(texts):
    data = np.frombuffer("".join(" " + t for t in texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len((" " + t).encode()) for t in texts])))
    numbers, digests, rows, pairs, times = alignment.aligner(A, B).slice(data, offsets, np.array([t != "" for t in texts]))
    want = expected(list(enumerate(texts)))
    assert [(*x, d) for x, d in zip(numbers.T.tolist(), digests, strict=True)] == [(*w[1:5], w[7]) for w in want]
    for r, t in enumerate(texts):
        links = Counter((a, b) for g in groups_of(t) for a in g[0] for b in g[1])
        assert {divmod(p, LIBRARY_B.get_piece_size()): n for p, n in zip(pairs[rows == r].tolist(), times[rows == r].tolist(), strict=True)} == links


def test_a_gap_that_a_token_spans_is_no_border():
    a_end, b_end = np.array([2, 5, 9, 10]), np.array([3, 5, 6, 7, 10])
    last_a, last_b = alignment.aligned(np.array([0, 2, 5, 9]), a_end, np.array([0, 3, 5, 6, 7]), b_end)
    assert last_a.tolist() == [1, 3] and last_b.tolist() == [1, 4]


def test_vocabulary_that_can_not_be_cut(monkeypatch):
    coder = alignment.SentencePieces(B)
    monkeypatch.setattr(coder, "separable", False)
    data = np.frombuffer(b" one two  three", np.uint8)
    ids, counts = coder.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == LIBRARY_B.encode("one two  three") and counts.tolist() == [len(ids)]


@pytest.mark.parametrize("block", [10, alignment.BLOCK_BYTES])
def test_operator_over_awkward_rows(docs, texts, block):
    assert sorted(tuple(r) for r in alignment.align(docs, A, B, block).collect()) == sorted(expected(list(texts.items())))


def test_null_ids_repeated_rows_and_empty_table(spark, empty):
    rows = [(None, "null id"), (4, "the same"), (4, "the same"), (5, None), (6, "a▁b"), (7, "")]
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected(rows), key=key)
    assert alignment.align(empty, A, B).count() == 0
    only_empty = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert [tuple(r)[1:] for r in only_empty] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query_over_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    random.Random(1).shuffle(rows)
    assert sorted(tuple(r) for r in QUERIES["op12_alignment"](spark, folder).collect()) == sorted(expected(rows))
