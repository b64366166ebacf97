from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import changes, graph, index, metrics, retrieval, snippets, textsearch
from factgraph.operators.index import FactError

NODES, EDGES = "namespace string, key string, kind string, display_name string", "src_ns string, src_key string, dst_ns string, dst_key string, relation string"


def make_graph(spark, pairs):
    keys = sorted({k for p in pairs for k in p[:2]})
    nodes = spark.createDataFrame([("n", k, "x", k) for k in keys], NODES)
    return nodes, spark.createDataFrame([("n", a, "n", b, r) for a, b, r in pairs], EDGES)


def walk(pairs, seed, depth, max_nodes, max_edges, direction):
    """The contract, one edge at a time."""
    keys = {k for p in pairs for k in p[:2]}
    if seed not in keys:
        return [], [], None
    visits, rank, admitted, queue = [(seed, 0)], {seed: 0}, [], [(seed, 0)]
    while queue:
        at, d = queue.pop(0)
        if d == depth:
            continue
        near = sorted(e for e in set(pairs) if direction != "incoming" and e[0] == at or direction != "outgoing" and e[1] == at)
        for e in near:
            if e in admitted:
                continue
            to = e[1] if e[0] == at and direction != "incoming" else e[0]
            if len(admitted) == max_edges:
                return visits, admitted, "edge_limit"
            if to not in rank and len(visits) == max_nodes:
                return visits, admitted, "node_limit"
            admitted.append(e)
            if to not in rank:
                rank[to] = len(rank)
                visits.append((to, d + 1))
                queue.append((to, d + 1))
    return visits, admitted, None


@pytest.mark.parametrize("seed", range(5))
def test_traverse_follows_the_contract(spark, seed):
    rng = random.Random(seed)
    pairs = list({(rng.choice("abcdef"), rng.choice("abcdef"), rng.choice("rs")) for _ in range(rng.randint(4, 12))})
    nodes, edges = make_graph(spark, pairs)
    depth, max_nodes, max_edges, direction = rng.randint(0, 3), rng.randint(1, 6), rng.randint(0, 8), rng.choice(["outgoing", "incoming", "both"])
    start = pairs[0][0]
    got = graph.traverse(nodes, edges.union(edges), "n", start, depth, max_nodes, max_edges, direction)
    visits, admitted, stop = walk(pairs, start, depth, max_nodes, max_edges, direction)
    assert [(r.key, r.depth) for r in got.visits.collect()] == visits
    assert sorted((r.src_key, r.dst_key, r.relation) for r in got.edges.collect()) == sorted(admitted) and got.stopped_by == stop


def test_missing_seed_and_relation_filters(spark):
    nodes, edges = make_graph(spark, [("a", "b", "r"), ("b", "b", "s"), ("c", "a", "s")])
    assert graph.traverse(nodes, edges, "n", "zz", 2).visits.count() == 0
    assert [r.key for r in graph.neighbors(nodes, edges, "n", "a").collect()] == ["b", "c"]
    assert [r.key for r in graph.neighbors(nodes, edges, "n", "b", "outgoing").collect()] == ["b"]
    assert graph.outgoing(edges, "n", "a", []).count() == 0 and graph.outgoing(edges, "n", "a", ["r"]).count() == 1
    with pytest.raises(FactError):
        graph.checked(nodes.where("key <> 'c'"), edges.withColumn("provenance", F.lit("p")))


def paths_by_stack(pairs, start, max_depth, max_paths, max_states):
    stack, out, states, issues = [((start,), ())], [], 0, set()
    while stack:
        if states >= max_states or len(out) >= max_paths:
            issues.add("state_or_path_limit")
            break
        nodes, keys = stack.pop()
        states += 1
        onward = sorted(e for e in set(pairs) if e[0] == nodes[-1])
        cut = [e for e in onward if e[1] in nodes]
        live = [e for e in onward if e[1] not in nodes]
        if cut:
            issues.add("cycle_cut")
        if live and len(keys) < max_depth:
            stack += [((*nodes, e[1]), (*keys, e)) for e in reversed(live)]
            continue
        if live:
            issues.add("depth_limit")
        out.append(nodes)
    return out, tuple(sorted(issues))


@pytest.mark.parametrize("seed", range(4))
def test_simple_paths_are_in_preorder(spark, seed):
    rng = random.Random(seed)
    pairs = list({(rng.choice("abcde"), rng.choice("abcde"), "r") for _ in range(rng.randint(4, 10))})
    _, edges = make_graph(spark, pairs)
    bounds = rng.choice([(4, 32, 1000), (2, 3, 1000), (4, 32, 3)])
    got = graph.simple_paths(edges, "n", pairs[0][0], *bounds)
    want, issues = paths_by_stack(pairs, pairs[0][0], *bounds)
    assert [tuple(n.key for n in r.path) for r in got.paths.collect()] == want and got.issues == issues and got.exhaustive == (not issues)


def test_edge_merge_is_commutative_and_idempotent(spark):
    rows = [("n", "a", "n", "b", "r", p) for p in ("p2", "p1", "p2")]
    once = graph.merge_evidence(spark.createDataFrame(rows, EDGES + ", provenance string"))
    for order in itertools.permutations(rows):
        assert graph.merge_evidence(spark.createDataFrame(list(order), EDGES + ", provenance string")).collect() == once.collect()


PLACE = "struct<file_path:string,start_line:int,start_column:int,end_line:int,end_column:int>"
OBSERVED = f"identity string, kind string, display_name string, qualified_name string, parent_identity string, namespace_identity string, declaration {PLACE}, definition {PLACE}, site {PLACE}, parent_kind string"


def test_canonical_symbols(spark):
    p, q, inside = ("f", 1, 1, 9, 1), ("g", 1, 1, 2, 1), ("f", 2, 1, 3, 1)
    rows = [
        ("ns", "namespace", "n", "n", None, None, p, None, None, None), ("ns", "namespace", "n", "n", None, None, q, None, None, None),
        ("two", "class", "c", "c", None, None, p, None, None, None), ("two", "class", "c", "c", None, None, q, None, None, None),
        ("m", "method", "run", "C::run", "C", "N", inside, None, inside, "class"), ("m", "method", "C::run", "C::run", "N", "N", None, q, q, "namespace"),
        ("bad", "method", "run", "C::run", "C", None, inside, None, None, None), ("bad", "method", "C::run", "C::run", None, None, None, q, None, None),
    ]
    got = {r.identity: r for r in index.canonical(spark.createDataFrame(rows, OBSERVED)).collect()}
    assert got["ns"].conflict is None and got["ns"].declaration.file_path == "f"
    assert got["two"].conflict == "declaration"
    assert (got["m"].conflict, got["m"].display_name, got["m"].parent_identity, got["m"].definition.file_path) == (None, "run", "C", "g")
    assert got["bad"].conflict == "declaration_site_containment"
    with pytest.raises(FactError, match="bad"):
        index.canonical_or_fail(spark.createDataFrame(rows, OBSERVED))


def test_text_search_edges(spark):
    files = spark.createDataFrame([("a.txt", "é😀aa aaa\r\nAA\n\n"), ("b/c.txt", "x.*y \\E\\Q x.*y"), ("e.txt", None)], "path string, content string")
    find = lambda **q: [tuple(r)[:6] for r in textsearch.search(files, textsearch.TextQuery(**q)).orderBy("path", "start_line", "start_column").collect()]
    assert find(text="aa") == [("a.txt", 1, 3, 1, 5, "aa"), ("a.txt", 1, 6, 1, 8, "aa")]
    assert [x[1:3] for x in find(text="aa", case_sensitive=False)] == [(1, 3), (1, 6), (2, 1)]
    assert [x[2] for x in find(text="x.*y")] == [1, 11] and [x[2] for x in find(text="\\E\\Q")] == [6]
    assert [x[5] for x in find(text="a{2,3}", regex=True)] == ["aa", "aaa"]
    assert find(text="aa", scope="b") == [] and len(find(text="aa", limit=1)) == 1
    for wrong in ({"text": ""}, {"text": "a\nb"}, {"text": "a", "limit": 0}, {"text": "a", "limit": True}):
        with pytest.raises(textsearch.QueryError):
            textsearch.TextQuery(**wrong)


def test_changed_blocks(spark):
    kinds = ["context", "delete", "add", "add", "no_newline", "context", "add", "context", "delete"]
    rows = spark.createDataFrame([(1, i, k, 10, 20) for i, k in enumerate(kinds)], "hunk int, seq int, kind string, old_start int, new_start int")
    got = [tuple(r)[1:] for r in changes.changed_blocks(rows, ["hunk"]).orderBy("block").collect()]
    assert got == [(1, 11, 12, 21, 23), (2, 13, 13, 24, 25), (3, 14, 15, 26, 26)]


def test_impact_status(spark):
    none = spark.createDataFrame([], "code string, path string, requires_full_rebuild boolean")
    some = spark.createDataFrame([("x", "p", True)], none.schema)
    assert changes.impact_status(some, "complete", False) == "full_rebuild" and changes.impact_status(none, "partial", True) == "full_rebuild"
    assert changes.impact_status(none, "unknown", False) == "unknown" and changes.impact_status(none, "complete", True) == "safe"


def test_clusters_touching_and_limit(spark):
    rows = spark.createDataFrame([("f", 0, 5, 1), ("f", 5, 9, 2), ("f", 8, 20, 3), ("f", 9, 9, 4), ("f", 30, 200, 5)], "path string, start long, end long, id long")
    got = {r.id: (r.cluster, r.status) for r in snippets.clusters(rows, ["path"], 50).collect()}
    assert got == {1: (1, "available"), 2: (2, "available"), 3: (2, "available"), 4: (2, "available"), 5: (3, "limit")}


def test_result_status_and_bounds(spark):
    reports = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    status = retrieval.result_status
    assert status(reports("ok", "failure")) == "failure" and status(reports("ok"), truncated=True) == "truncated" and status(reports("unresolved", "unsupported")) == "unresolved"
    assert status(reports("ok", "unsupported")) == "unsupported" and status(reports("empty")) == "empty" and status(reports("ok"), diagnostics=True) == "unresolved"
    with pytest.raises(ValueError):
        retrieval.Bounds(names=0)


def test_metrics_without_matches(spark):
    expected = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "case_id string, item string")
    observed = spark.createDataFrame([("a", "q", 1), ("a", "y", 2)], "case_id string, item string, rank int")
    assert {r.case_id: r.mrr for r in metrics.reciprocal_rank(expected, observed).collect()} == {"a": 0.5, "b": 0.0}
    assert {r.case_id: (r.recall_at_1, r.recall_at_5) for r in metrics.recall_at(expected, observed).collect()} == {"a": (0.0, 0.5), "b": (0.0, 0.0)}
