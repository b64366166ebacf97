from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factgraph.operators import expansion, runner, traces
from factgraph.operators.index import FactError
from factgraph.sources import graphs
from tests.test_operators import EDGES, make_graph

NODE = "namespace string, key string"


def test_expansion_admits_a_seed_whole_or_not(spark):
    nodes, edges = make_graph(spark, [("a", "b", "r"), ("b", "c", "r"), ("d", "e", "r"), ("e", "f", "r")])
    seeds = spark.createDataFrame([("n", "d"), ("n", "a"), ("n", "a")], NODE)
    got = expansion.expand(nodes, edges, seeds, expansion.Policy(nodes=4))
    assert [r[1:] for r in got.reports] == [("a", "admitted", None, 3, 2), ("d", "truncated", "node_cap", 0, 0)]
    assert {r.key for r in got.nodes.collect()} == {"a", "b", "c"} and got.edges.count() == 2
    assert [r[1:4] for r in expansion.expand(nodes, edges, seeds, expansion.Policy(queries=1)).reports] == [("a", "admitted", None), ("d", "truncated", "query_limit")]
    for wrong in ({"depth": -1}, {"nodes_per_seed": 0}):
        with pytest.raises(ValueError):
            expansion.Policy(**wrong)


def test_context_inherits_paths(spark):
    nodes = spark.createDataFrame([("n", "a"), ("n", "b")], NODE)
    edges = spark.createDataFrame([("n", "a", "n", "b", "r")], EDGES)
    candidates = spark.createDataFrame([("a",), ("a",)], "fact_key string")
    places = spark.createDataFrame([("a", "x.h"), ("a", "x.cpp")], "symbol_identity string, file_path string")
    got = {(r.kind, r.context_key): (r.paths, r.retrieved) for r in expansion.context(nodes, edges, candidates, places).collect()}
    assert got == {("node", "a"): (["x.cpp", "x.h"], True), ("node", "b"): ([], False), ("relation", "a>b>r"): (["x.cpp", "x.h"], False)}


def test_verified_edges_need_all_evidence(spark):
    schema = EDGES + ", provenance string"
    edge = lambda a, b, p: ("n", a, "n", b, "r", p)
    projected = spark.createDataFrame([edge("a", "b", "p1"), edge("a", "b", "p2"), edge("b", "c", "p1")], schema)
    supplied = spark.createDataFrame([edge("a", "b", "p2"), edge("a", "b", "p1"), edge("a", "b", "more"), edge("b", "c", "other")], schema)
    assert {(r.src_key, r.proofs, r.state) for r in traces.verified_edges(supplied, projected).collect()} == {("a", 2, "verified"), ("b", 1, "broken")}


def test_template_relations(spark):
    files = spark.createDataFrame([("a.h", "class A {\n  void Make();\n};\n"), ("a.cpp", "void A::Make() { New(); }\n")], "path string, content string")
    symbols = spark.createDataFrame([("A", None, "A"), ("A::Make", "A", "Make"), ("A::Bad", "A", "Bad"), ("f", None, "Make")], "identity string, parent_identity string, display_name string")
    places = spark.createDataFrame([("A::Make", "declaration", "a.h", 2, 3), ("A::Make", "definition", "a.cpp", 1, 1), ("A::Bad", "declaration", "a.h", 2, 3)], "symbol_identity string, role string, file_path string, start_line int, start_column int")
    mapping = spark.createDataFrame([("A", "recognized", "pattern/button")], "identity string, status string, candidates string")

    def found(*templates):
        rows = spark.createDataFrame([("pattern", *t) for t in templates], "role string, method string, relation string, declaration_pattern string, body_pattern string")
        return {r.method_id: r.diagnostic for r in traces.template_relations(symbols, places, files, mapping, rows).collect()}

    assert found(("Make", "creates", r"^void\s+Make\(", r"New\("), ("Bad", "creates", "void", "x")) == {"A::Make": None, "A::Bad": "missing_definition"}
    assert found(("Make", "creates", "^int", r"New\(")) == {"A::Make": "unsupported_declaration_template"}
    assert found(("Make", "creates", "^void", "Old")) == {"A::Make": "unsupported_body_template"}


@pytest.mark.parametrize(
    ("pairs", "status", "gaps"),
    [
        ([("s", "m", "r"), ("m", "e", "r"), ("e", "x", "r"), ("s", "y", "r")], "complete", [[]]),
        ([("s", "e", "r")], "incomplete", [["missing_middle_stage"]]),
        ([("s", "e", "r"), ("s", "m", "r"), ("m", "e", "r")], "ambiguous", [["missing_middle_stage"], []]),
        ([("e", "s", "r")], "incomplete", []),
    ],
)
def test_staged_trace(spark, pairs, status, gaps):
    _, edges = make_graph(spark, pairs)
    stages = spark.createDataFrame([("n", "s", "entry"), ("n", "m", "middle"), ("n", "e", "end")], NODE + ", stage string")
    got = traces.staged_trace(edges, stages, ("n", "s"), ["entry", "middle", "end"])
    assert got.status == status and [r.gaps for r in got.paths.orderBy("state").collect()] == gaps
    assert ("missing_entry_stage" in got.issues) == (not gaps)


def test_runner_scores_each_case(spark):
    place = "symbol_identity string, role string, file_path string, start_line int, start_column int, end_line int, end_column int"
    tables = {
        "files": spark.createDataFrame([("a.txt", "one two\nthree")], "path string, content string"),
        "symbols": spark.createDataFrame([("A", "class", "Make", "N::Make"), ("B", "function", "Run", "N::Run")], "identity string, kind string, display_name string, qualified_name string"),
        "symbol_ranges": spark.createDataFrame([("A", "definition", "a.cpp", 3, 1, 4, 1)], place),
        "symbol_relations": spark.createDataFrame([("A", "callee", "B"), ("B", "caller", "A")], "source_identity string, relation_kind string, target_identity string"),
    }
    suite = [
        {"case_id": "text", "kind": "text_search", "text": "two", "expected": ["a.txt:000000001:000000005"]}, {"case_id": "name", "kind": "search_symbol", "text": "Make", "expected": ["A", "zz"]},
        {"case_id": "wrong", "kind": "nothing", "text": "x", "expected": ["q"]}, {"case_id": "place", "kind": "definition", "text": "A", "expected": ["a.cpp:3"]},
        {"case_id": "up", "kind": "callers", "text": "B", "expected": ["A"]}, {"case_id": "down", "kind": "callees", "text": "A", "expected": ["B"], "limit": 1},
    ]
    got = {r.case_id: (r.recall, r.failures, r.error) for r in runner.run(spark, suite, tables).collect()}
    assert got.pop("wrong")[1:] == ("query_rejected", True) and got.pop("name") == (0.5, "target_symbol_miss", False)
    assert set(got.values()) == {(1.0, "", False)} and len(got) == 4


def test_graph_store_keeps_scopes_apart(spark, tmp_path):
    nodes, edges = make_graph(spark, [("a", "b", "r")])
    evidence = edges.withColumn("provenance", F.lit("p"))
    store = graphs.GraphStore(spark, f"file://{tmp_path}/graphs")
    store.save("one", "s", nodes, evidence.union(evidence))
    got = store.load("one", "s")
    assert got[0].count() == 2 and got[1].collect() == evidence.collect()
    with pytest.raises(FactError):
        store.save("two", "s", nodes.where("key = 'a'"), evidence)
    assert store.delete("one", "s") and not store.delete("one", "s")


def test_codec_refuses_other_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    lines = graphs.encoded(rows)
    assert sorted(graphs.decoded(lines, "a int, b string").collect()) == sorted(rows.collect(), key=lambda r: r.a)
    with pytest.raises(FactError):
        graphs.decoded(lines, "a int")
