import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgraph.llm import periodic_runs
from factgraph.llm.queries import QUERIES


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute(words):
    """All runs by looking at every period and every stretch."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(6, 4 * q) and smallest_period(words[i : e + q]) == q:
                out.append((i, e + q - i, q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted=True):
    words = [] if text is None else text.encode().split()
    n = len(words)
    if planted and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a + p, n):
            words[i] = words[i - p]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), st.integers(1, 9), st.integers(1, 60))
def test_runs_equal_brute_force(words, period, length):
    built = words[:30] + [words[i % min(period, len(words))] for i in range(length)] + words[30:] if words else words
    for text in (words, built):
        assert periodic_runs.runs(periodic_runs.numbered(text)) == brute(text)


def test_nested_powers_and_parts_of_the_grid(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(periodic_runs, "PROBES", 16)
    monkeypatch.setattr(periodic_runs, "CHUNK", 2)
    for _ in range(60):
        block = [rng.choice("ab") for _ in range(rng.randint(1, 7))]
        words = [rng.choice("abc") for _ in range(rng.randint(0, 9))] + (block * 5 + [rng.choice("ab")]) * rng.randint(1, 5) + block * 3
        assert periodic_runs.runs(periodic_runs.numbered(words)) == brute(words)


def test_one_word_repeated_a_hundred_thousand_times():
    words = [b"x"] * 100_000
    assert periodic_runs.runs(periodic_runs.numbered(words)) == [(0, 100_000, 1)]
    assert periodic_runs.kept(len(words), [(0, 100_000, 1)]).sum() == 1


def test_ties_go_to_the_first_start():
    words = [b"a"] * 8 + [b"z"] + [b"b"] * 8 + [b"c", b"d"] * 8
    assert periodic_runs.strongest(brute(words)) == (0, 8, 1)


@pytest.mark.parametrize("planted", [True, False])
def test_operator_over_awkward_rows(docs, texts, planted):
    got = periodic_runs.find(docs, planted).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.doc_id, len(r.runs), r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, texts[r.doc_id], planted)


def test_null_ids_repeated_rows_and_empty_table(spark, empty):
    rows = [(None, "a a a a a a"), (7, None), (8, "b c " * 9), (8, "b c " * 9), (9, "\x1c \x1c x y" * 5)]
    got = periodic_runs.find(spark.createDataFrame(rows, "doc_id long, text string"), True).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, len(r.runs), r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got), key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert periodic_runs.find(empty).count() == 0


def test_query_over_a_whole_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("a", "b", "no", "yes")) for _ in range(rng.choice((0, 5, 40, 90))))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns[:8] == columns
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(expected(i, t) for i, t in rows)
    assert sum(1 for i, t in rows if t and zlib.crc32(str(i).encode()) % 10 == 0) > 3
