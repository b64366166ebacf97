import re
from collections import Counter

from factgraph.llm import decontaminate
from tests.llm.conftest import prose


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """Best similarity of any item-sized window."""
    split = lambda t: [w for w in re.split("[ \t-\r]+", (t or "").lower()) if w]
    out = {}
    for q, text in items.items():
        item = split(text)
        if not item:
            continue
        k = min(5, len(item))
        want = shingles(item, k)
        for d, t in docs.items():
            words = split(t)
            for s in range(max(1, len(words) - k + 1)):
                own = shingles(words[s : s + len(item)], k)
                if own and (alike := sum((own & want).values()) / sum((own | want).values())) >= 0.8:
                    out[d, q] = max(out.get((d, q), 0), alike)
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(d, b).collect()}


def test_exact_and_near_items_are_found_and_clean_ones_left(spark, texts):
    items = {i: prose(500 + i, 20 + 3 * i) for i in range(8)} | {90: "alpha beta", 91: None, 92: ""}
    docs = dict(texts)
    for i in range(8):
        words = items[i].split()
        docs[200 + i] = prose(700 + i, 40) + " " + items[i].replace("the", "THE") + "\n" + prose(800 + i, 30)
        docs[300 + i] = prose(900 + i, 10) + " " + " ".join([*words[:9], "other", *words[10:]]) + " " + prose(950 + i, 10)
        docs[400 + i] = " ".join(words[: len(words) // 2]) + " " + prose(990 + i, 50)
    docs[500] = "say Alpha beta twice"
    got, want = found(spark, docs, items), brute(docs, items)
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-9 or got[p] < want[p] for p in got)
    assert {(200 + i, i) for i in range(8)} <= set(got) and (500, 90) in got
    assert len(got) >= 0.9 * len(want)


def test_blocks_guarantee_the_radius():
    n = decontaminate.RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    assert edges[0] == 0 and edges[-1] == 64 and all(a < b for a, b in zip(edges, edges[1:], strict=False))


def test_empty_tables(spark, empty, docs):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).count() == 0


def test_near_items_down_to_the_threshold_are_found(spark):
    docs, items, want = {}, {}, {}
    for n in (20, 22, 31, 41, 60, 103, 200):
        for ends in (True, False):
            for part in (1.0, 0.5):
                for i in range(8):
                    q = len(items)
                    item = prose(20_000 + q, n).split()
                    best = None
                    for c in range(1, n):
                        at = {(n - 1 - j) if ends else (j * n // c + n // (2 * c)) for j in range(c)}
                        near = [f"new{q}x{j}" if j in at else w for j, w in enumerate(item)]
                        a, b = shingles(near, 5), shingles(item, 5)
                        alike = sum((a & b).values()) / sum((a | b).values())
                        if alike < 1 - 0.2 * part:
                            break
                        best = near, alike
                    if best:
                        items[q] = " ".join(item)
                        docs[q] = prose(40_000 + q, 15) + " " + " ".join(best[0]) + " " + prose(60_000 + q, 15)
                        want[q, q] = best[1]
    got = found(spark, docs, items)
    missed = {p: alike for p, alike in want.items() if p not in got}
    assert len(want) > 100 and min(want.values()) < 0.81 and len(missed) <= 0.01 * len(want), missed
