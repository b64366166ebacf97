import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import words
from tests.llm.conftest import thue_morse


def hashes(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return words.word_hashes(data, np.concatenate(([0], ends[:-1])), ends).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=9), min_size=1, max_size=9))
def test_spans_of_equal_bytes_have_equal_hashes_wherever_they_stand(texts):
    for texts_ in (texts, texts[::-1]):
        got = dict(zip(texts_, hashes(texts_), strict=True))
        assert len(set(got.values())) == len(got)
        assert hashes([texts[0]]) == [got[texts[0]]]


def test_words_that_meet_modulo_a_power_of_two_are_told_apart():
    assert len(set(hashes(thue_morse()))) == 2


def test_long_data_gives_the_same_hashes(monkeypatch):
    texts = ["one", "two" * 50, "", "zebra"]
    want = hashes(texts)
    monkeypatch.setattr(words, "SUMMED", 4)
    assert hashes(texts) == want


def test_kinds_differ():
    spans = words.Spans(np.frombuffer(b"abc", np.uint8))
    assert len({int(spans.hashes(np.array([0]), np.array([3]), kind)[0]) for kind in range(3)}) == 3
