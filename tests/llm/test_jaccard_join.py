import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import jaccard_join, signature_tree
from factgraph.llm.components import components
from tests.llm.conftest import prose, thue_morse


def brute(texts, k=3, percent=90):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent, links = {i: i for i in sets}, {i: 0 for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(docs, **options).collect()}
    assert got == brute(texts)


def variants(seed, n, size):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = {}
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        out[i] = " ".join(own).upper() if i % 7 == 0 else " ".join(own)
    return out


def test_near_copies_of_many_sizes(spark, texts):
    rows, at = dict(texts), 1000
    for seed, (n, size) in enumerate([(12, 4), (14, 11), (14, 12), (20, 13), (20, 40), (30, 150)]):
        for t in variants(seed, n, size).values():
            rows[at], at = t, at + 1
    check(spark, rows)


def test_words_that_meet_modulo_a_power_of_two_are_told_apart(spark):
    check(spark, {i: f"{w} x y" for i, w in enumerate(thue_morse())})


def test_chunks_find_links_across_tasks(spark):
    check(spark, variants(3, 40, 120), chunk=7)


def test_empty_and_repeats(spark, empty):
    assert jaccard_join.join(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    rows = jaccard_join.join(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == {1: (2, 1, 0), None: (2, None, 0)} and len(rows) == 2


def test_rows_of_one_doc_id_with_different_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "x y z"), (2, "A b c d e f g"), (3, "x y z"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(docs).collect()} == {1: (5, 1, 1), 2: (5, 1, 1), 3: (1, 3, 0)}


def test_a_group_that_percolates(spark):
    """Each text is near the one before, so 300 texts are one group, though few pairs of nodes can be linked."""
    words, rows = [f"w{i}" for i in range(200)], {}
    for i in range(300):
        rows[i] = " ".join(words)
        words = words[2:] + [f"w{200 + 2 * i}", f"w{201 + 2 * i}"]
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute(rows, 5, 80)
    assert {c for _, c, _ in want.values()} == {0}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(docs, 5, 80, chunk=16).collect()} == want


def test_sets_whose_tokens_no_other_set_holds_send_no_signatures(spark, monkeypatch):
    """Texts that share a third of their shingles meet by chance parts; they can't be linked, as too many tokens of theirs are alone."""
    common, met = prose(50, 60), []
    rows = {i: common + " " + prose(300 + i, 120) for i in range(40)} | {100: prose(1, 90) + " a", 101: prose(1, 90) + " b", 102: prose(1, 90) + " b"}
    before = jaccard_join.meetings
    monkeypatch.setattr(jaccard_join, "meetings", lambda docs, *a: met.extend(r.doc_id for r in docs.collect()) or before(docs, *a))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(docs, 5, 80).collect()}
    assert got == brute(rows, 5, 80) and got[102][1:] == (100, 2)
    assert sorted(met) == [100, 101]


@settings(max_examples=200, deadline=None)
@given(st.integers(10, 400), st.integers(0, 90), st.sampled_from([80, 90]), st.integers(0, 10**6))
def test_linked_sets_have_few_counted_tokens_alone(size, changed, percent, seed):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    two = np.unique(np.concatenate((one[: max(1, len(one) - changed)], rng.integers(0, 2**63, changed // 2, dtype=np.uint64))))
    common = len(np.intersect1d(one, two))
    if 100 * common >= percent * (len(one) + len(two) - common):
        for a, b in ((one, two), (two, one)):
            own = jaccard_join.counted(a, percent)
            assert 100 * (len(own) - len(np.intersect1d(own, jaccard_join.counted(b, percent)))) <= (100 - percent) * len(a)


def test_copies_of_one_text_beyond_the_heavy_bound(spark, monkeypatch):
    monkeypatch.setattr("factgraph.llm.tables.HEAVY", 2)
    near = variants(9, 30, 60)
    rows = {i: near[i % 2] for i in range(1500)} | {2000 + i: t for i, t in near.items()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.join(docs).collect()}
    want = brute({i: rows[i] for i in (0, 1, *range(2000, 2030))})
    size = {0: 750, 1: 750}
    assert len(got) == 1530
    for i in range(2000, 2030):
        sets = [set(zip(*(rows[j].lower().split()[k:] for k in range(3)))) for j in (i, 0, 1)]
        extra = sum(size[c] - 1 for c in (0, 1) if 100 * len(sets[0] & sets[c + 1]) >= 90 * len(sets[0] | sets[c + 1]))
        assert got[i] == want[i][2] + extra


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=25), max_size=30), st.sampled_from([50, 80, 90]))
def test_tree_join_equals_all_pairs(sets, percent):
    own = [np.array(sorted(s), np.uint64) for s in sets]
    a, b = signature_tree.join(own, None, percent)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want
    half = len(own) // 2
    a, b = signature_tree.join(own[:half], own[half:], percent)
    assert set(zip(a.tolist(), (b + half).tolist(), strict=True)) == {p for p in want if p[0] < half <= p[1]}


@settings(max_examples=200, deadline=None)
@given(st.integers(10, 400), st.integers(0, 30), st.integers(0, 10**6))
def test_linked_sets_share_a_signature(size, changed, seed):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    two = np.unique(np.concatenate((one[: max(1, len(one) - changed)], rng.integers(0, 2**63, changed // 2, dtype=np.uint64))))
    common = len(np.intersect1d(one, two))
    if 100 * common >= 90 * (len(one) + len(two) - common) and (len(one) != len(two) or (one != two).any()):
        assert set(jaccard_join.signatures(one, 90).tolist()) & set(jaccard_join.signatures(two, 90).tolist())


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 5), (4, 4), (None, 1)] + [(100, 200 + i) for i in range(30)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got[3] == 1 and got[9] == 5 and got[210] == 100 and 4 not in got
