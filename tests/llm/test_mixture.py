import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from factgraph.llm import mixture


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=6), st.integers(0, 60))
def test_apportion_is_highest_quotients(votes, seats):
    votes = np.array(votes)
    won = mixture.apportion(votes, seats)
    want = np.zeros(len(votes), int)
    if votes.sum() > 0:
        for _ in range(seats):
            want[np.argmax(votes / (2 * want + 1))] += 1
    assert won.sum() == (seats if votes.sum() > 0 else 0) and (np.sort(votes / (2 * won + 1)) == np.sort(votes / (2 * want + 1))).all()


def test_mix_reaches_targets_and_bounds(spark):
    rows = [(i, "w " * (30 + i % 50), "big" if i % 3 else f"s{i % 4}") for i in range(900)]
    docs = spark.createDataFrame([*rows, (1000, None, None), (1001, "a b c", None)], "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixture.mix(docs).drop("pieces", "code", "rows", "copy").collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == 902
    totals, target = {}, {}
    for _, source, size, source_size, goal, taken in first:
        totals[source], target[source] = totals.get(source, 0) + taken, goal
        assert 0 <= taken <= 3 * size
    assert abs(sum(target.values()) - sum(r[2] for r in first)) < 1e-6 * sum(r[2] for r in first) or any(target[s] == 3 * sum(r[2] for r in first if r[1] == s) for s in target)
    for s in ("big", "s0", "s1", "s2", "s3"):
        if s in totals:
            assert abs(totals[s] - target[s]) <= 0.05 * target[s]


def test_targets_stop_at_three_times(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b")], "doc_id long, text string, source string")
    got = {r.key: r.target for r in mixture.targets(mixture.sizes(docs)).collect()}
    assert got == {"sa": 30.0, "sb": 980.0}


def test_mixed_texts_have_the_taken_words(docs, empty):
    plan = {r.doc_id: r.taken for r in mixture.mix(docs).collect()}
    words = {}
    for r in mixture.mixed(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text)])
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in plan.items() if v}
    assert mixture.mix(empty).count() == 0 and mixture.mixed(docs).columns == docs.columns


def brute(rows):
    """Words taken of each document of one shard, word by word."""
    total = {}
    for _, n, s in rows:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), sum(total.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= 3 * total[s]]
        for s in full or open_:
            target[s] = 3 * total[s] if full else weight[s] * unit
        left -= sum(3 * total[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    keys = sorted(total, key=lambda s: "n" if s is None else "s" + s)
    full = [target[s] >= 3 * total[s] for s in keys]
    votes, won = [0.0 if f else float(target[s]) for s, f in zip(keys, full, strict=True)], [0] * len(keys)
    for _ in range(round(sum(votes) / 32)):
        i = max(range(len(keys)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    taken = {}
    for s, quota, f in zip(keys, won, full, strict=True):
        ids = [i for i, _, own in rows if own == s]
        hashes = dict(zip(ids, mixture.seeded(np.array(ids), mixture.SEED).tolist(), strict=True))
        stream = [i for i in sorted(ids, key=lambda i: (hashes[i], i)) for _ in range(next(n for j, n, _ in rows if j == i))]
        blocks = [stream[a : a + 32] for a in range(0, len(stream), 32)]
        passes, rest = divmod(3 * len(stream) if f else 32 * quota, len(stream)) if blocks else (0, 0)
        if passes >= 3:
            passes, rest = 3, 0
        rank, held = mixture.seeded(np.arange(len(blocks)), mixture.SEED + 1).tolist(), 0
        for i in ids:
            taken[i] = passes * stream.count(i)
        for b in sorted(range(len(blocks)), key=lambda b: rank[b]):
            held += len(blocks[b])
            if rest and held - len(blocks[b]) / 2 <= rest:
                for i in blocks[b]:
                    taken[i] += 1
    return taken, target


def test_mix_takes_what_brute_force_takes(spark):
    names = ["a", "é", "\uffee", "\U0001f600", None, "Z", "zz"]
    rows = [(i, (i * 7) % 60, names[(i * i + i // 3) % len(names)]) for i in range(200)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    taken, target = brute(rows)
    got = {r.doc_id: (r.taken, r.target) for r in mixture.mix(docs).collect()}
    assert {i: t for i, (t, _) in got.items()} == taken
    assert all(abs(got[i][1] - target[s]) < 1e-6 * max(1, target[s]) for i, _, s in rows)


def test_mixed_with_repeated_rows_and_clashing_names(spark):
    long = "one  two\n\nthree " * 40
    rows = [(1, None, "a", 3, "x"), (1, long, "a", 3, "y"), (1, long, "a", 3, "y"), (2, "b c d", "a", 1, "z"), (None, "e f", None, 2, "q"), (3, "", "b", 0, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, pieces string").selectExpr("*", "1 as _doc0", "2 as _rows0", "3 as _passes0", "4 as _pieces0")
    plan = {}
    for r in mixture.mix(docs).collect():
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.taken
    got = mixture.mixed(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    words = {}
    for r in got.collect():
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(mixture.WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r.pieces in ("y", "z", "q") and (r.doc_id != 1 or r.text in long or "\n" in r.text)
    assert words == {k: v for k, v in plan.items() if v}


def test_partial_passes_keep_what_stands_between_words():
    assert mixture.cut("a  b\n\nc\td e", [{"first": 1, "words": 2}, {"first": 4, "words": 1}]) == "b\n\nc\ne"
    assert mixture.cut("a  b\n\nc\td e", [{"first": 1, "words": 1}, {"first": 2, "words": 2}]) == "b\n\nc\td"


def test_every_row_is_a_document(spark):
    def row(i, s, n):
        return (i, " ".join(f"w{i}" for i in range(n)), s, "x")

    rows = [row(1, "a", 30), row(1, "a", 20), row(2, "a", 50), row(3, "b", 10), row(3, "b", 10), row(None, "b", 4), row(None, "b", 4), row(None, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    plan = mixture.mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in plan) == sorted((str(i), len(t.split())) for i, t, _, _ in rows)
    assert {r.source: r.source_size for r in plan} == {"a": 100, "b": 35}
    words = sum(len(mixture.WORD.findall(r.text)) for r in mixture.mixed(docs).collect())
    assert words == sum(r.taken for r in plan)


def test_small_sources_get_their_share(spark):
    rows = [(i, "w " * 60, "a") for i in range(3000)] + [(5000 + i, "v " * 8, "b") for i in range(30)] + [(6000 + i, "u " * 8, "c") for i in range(900)]
    plan = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in plan:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert target["b"] == 720 and taken["b"] == 720
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in taken)
