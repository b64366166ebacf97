from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factgraph.functions import ranges
from factgraph.operators import changes, graph, index, intervals, ranks
from tests.test_operators import make_graph, walk

RANGED = "name string, file_path string, start_line long, end_line long"


def test_ranks_and_sums_over_partitions(spark):
    rows = [(i * 7919 % 1000, "abc"[i % 3], i % 5 if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g string, w long").repartition(7)
    got = {r.k: r for r in ranks.ranked(df, ["k"], "at", sums={"before": F.col("w")}).collect()}
    total = 0
    for at, (k, g, w) in enumerate(sorted(rows)):
        assert (got[k].at, got[k].before, got[k].g) == (at, total, g)
        total += w or 0
    within = {r.k: r for r in ranks.ranked(df, ["g", "k"], "at", ["g"], {"before": F.col("w")}).collect()}
    for group in "abc":
        total = 0
        for at, (k, _, w) in enumerate(sorted(r for r in rows if r[1] == group)):
            assert (within[k].at, within[k].before) == (at, total)
            total += w or 0
    assert ranks.ranked(df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        ranks.ranked(df, ["k"], within=["g"])


def test_groups_without_a_value_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 1)], "g string, k long")
    assert sorted((r.g or "", r.k, r.rank) for r in ranks.ranked(df, ["g", "k"], within=["g"]).collect()) == [("", 1, 0), ("", 2, 1), ("x", 1, 0)]


def test_no_window_over_a_whole_table():
    for name in ("graph", "service", "runner", "ranks", "expansion", "intervals"):
        text = Path(graph.__file__).with_name(f"{name}.py").read_text(encoding="utf-8")
        assert "Window.orderBy" not in text, name


@pytest.mark.parametrize("seed", range(4))
def test_searches_from_many_seeds_are_as_if_alone(spark, seed):
    rng = random.Random(100 + seed)
    pairs = list({(rng.choice("abcdefgh"), rng.choice("abcdefgh"), rng.choice("rs")) for _ in range(rng.randint(8, 24))})
    nodes, edges = make_graph(spark, pairs)
    depth, max_nodes, max_edges, direction = rng.randint(1, 3), rng.randint(1, 7), rng.randint(0, 9), rng.choice(["outgoing", "incoming", "both"])
    names = sorted({x for p in pairs for x in p[:2]})
    seeds = spark.createDataFrame([(i, "n", k) for i, k in enumerate([*names, "absent"])], "seed long, namespace string, key string")
    got = graph.search(nodes, edges, seeds, depth, max_nodes, max_edges, direction)
    visits, admitted, stops = ({} for _ in range(3))
    for r in got.visits.orderBy("seed", "rank").collect():
        visits.setdefault(r.seed, []).append((r.key, r.depth))
    for r in got.edges.collect():
        admitted.setdefault(r.seed, set()).add((r.src_key, r.dst_key, r.relation))
    for r in got.stops.collect():
        stops[r.seed] = (r.stopped_by, r.n_nodes, r.n_edges)
    for i, k in enumerate(names):
        want_visits, want_edges, stop = walk(pairs, k, depth, max_nodes, max_edges, direction)
        assert visits[i] == want_visits and admitted.get(i, set()) == set(want_edges)
        assert stops[i] == (stop, len(want_visits), len(want_edges))
    assert len(names) not in stops


def meets(a, b):
    return a[1] == b[1] and max(a[2], b[2]) <= min(a[3], b[3])


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_ranges_that_meet_come_once(spark, seed):
    rng = random.Random(seed)

    def some(n, longest):
        out = []
        for i in range(n):
            start = rng.randint(-5, 200)
            out.append((f"r{i}", rng.choice("fg"), start, start + rng.choice((0, 0, 1, 2, rng.randint(0, longest)))))
        return out

    left, right = some(80, 64), some(90, 200)
    rows = [spark.createDataFrame([*x, ("no file", None, 1, 9), ("no line", "f", None, 9)], RANGED) for x in (left, right)]
    got = intervals.overlapping(*rows, [("file_path", "file_path")], ("start_line", "end_line"), ("start_line", "end_line"))
    pairs = [(r.left.name, r.right.name) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a[0], b[0]) for a in left for b in right if meets(a, b)}
    assert intervals.overlapping(rows[0], rows[1].limit(0), [("file_path", "file_path")], ("start_line", "end_line"), ("start_line", "end_line")).count() == 0


def test_a_file_of_a_hundred_thousand_ranges(spark):
    """Candidates stay near the pairs that meet; by the file alone they would be 10**10."""
    n = 100_000
    bodies = spark.range(n).select(F.concat(F.lit("c"), "id").alias("case_identity"), F.lit("hot.cpp").alias("file_path"), (10 * F.col("id") + 1).alias("start_line"), F.lit(1).cast("long").alias("start_column"), (10 * F.col("id") + 9).alias("end_line"), F.lit(1).cast("long").alias("end_column"))
    references = spark.range(n).select(F.lit("s").alias("symbol_identity"), F.lit("hot.cpp").alias("file_path"), (10 * F.col("id") + F.col("id") % 10 + 1).alias("start_line"), F.lit(2).cast("long").alias("start_column"), (10 * F.col("id") + F.col("id") % 10 + 1).alias("end_line"), F.lit(5).cast("long").alias("end_column"))
    found = index.contained_references(references, bodies)
    assert found.count() == n // 10 * 8
    anchors = spark.range(n).select(F.concat(F.lit("a"), "id").alias("anchor_id"), F.lit("hot.cpp").alias("file_path"), (10 * F.col("id") + 3).alias("start_line"), (10 * F.col("id") + 5).alias("end_line"))
    extents = bodies.select(F.col("case_identity").alias("symbol_identity"), F.lit("definition").alias("role"), *ranges.FIELDS)
    whole = spark.createDataFrame([("all", "definition", "hot.cpp", 1, 1, 10 * n, 1)], extents.schema)
    got = changes.mapped_symbols(anchors, extents.union(whole))
    assert got.count() == 2 * n and got.where("relation <> 'enclosing'").count() == 0
    assert got.where("symbol_identity = 'all'").count() == n


def test_release_removes_what_was_written(spark):
    from factgraph.sources import workspace

    held = workspace._HELD.pop(spark.sparkContext.applicationId, [])
    try:
        found = workspace.written(spark.range(3))
        assert found.count() == 3
        folder = Path(found.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists() and workspace.release(spark) == 1 and not folder.exists()
        assert workspace.release(spark) == 0
    finally:
        workspace._HELD[spark.sparkContext.applicationId] = held


def test_ranks_beside_sums_over_several_partitions(spark):
    """A group that a partition's end cuts keeps its places: rows in front are counted, not summed."""
    rows = [(g, i, 10 * (i % 2)) for g in range(41) for i in range(7)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranks.ranked(spark.createDataFrame(rows, "g long, i long, w long"), ["g", "i"], "at", ["g"], {"before": F.col("w")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.g, r.i, r.at, r.before) for r in found) == [(g, i, i, 10 * (i // 2)) for g, i, _ in rows]
