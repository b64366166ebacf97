import re
from collections import Counter

from factgraph.llm import quality
from tests.llm.conftest import thue_morse

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counters_match_brute_force(docs, texts):
    rows = quality.assess(docs, None).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)


def test_lines_that_meet_modulo_a_power_of_two_are_told_apart(spark):
    text = "\n".join(thue_morse())
    row = quality.assess(spark.createDataFrame([(1, text)], "doc_id long, text string"), None).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute(text) and row.n_dup_lines == 0


def test_model_learns_and_tells_junk(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "###" for w in prose(i, 60).split())) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.assess(docs, quality.train(docs, labels)).collect()}
    assert sum(got[i] == (i % 3 > 0) for i in range(100, 150)) >= 48


def test_one_class_and_empty(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    assert quality.train(empty, labels) is None
    assert quality.assess(empty, None).count() == 0


def test_character_grams_are_of_whole_characters():
    import numpy as np
    import pyarrow as pa

    from factgraph.llm.words import text_slices

    texts = ["aé日b😀c", "日é", None, "abcd"]
    _, data, offsets = next(iter(text_slices(pa.array(texts))))
    _, words, bounds = quality.counters(data, offsets)
    for n, (got, at) in zip((3, 4), list(quality.buckets(data, offsets, words, bounds))[2:], strict=True):
        assert np.diff(at).tolist() == [max(0, len(t or "") - n + 1) for t in texts]
        grams = {}
        for r, t in enumerate(texts):
            for i, bucket in enumerate(got[at[r] : at[r + 1]].tolist()):
                grams.setdefault((t or "")[i : i + n], set()).add(bucket)
        assert all(len(b) == 1 for b in grams.values()) and len({min(b) for b in grams.values()}) == len(grams)
    points, at = quality.code_points(np.frombuffer(b"a\xff\x80bc\xc3", np.uint8), np.array([0, 3, 6]))
    assert at[-1] == len(points)
