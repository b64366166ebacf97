from __future__ import annotations

from factgraph.operators import creation_trace, layout_trace

SPOT = "symbol_identity string, {}file_path string, start_line long, start_column long, end_line long, end_column long"
NAMED = "identity string, kind string, qualified_name string, parent_identity string"


def tables(spark, symbols, ranges, references, calls, files, mapping):
    return {
        "symbols": spark.createDataFrame(symbols, NAMED), "symbol_ranges": spark.createDataFrame(ranges, SPOT.format("role string, ")), "references": spark.createDataFrame(references, SPOT.format("")),
        "calls": spark.createDataFrame(calls, "caller string, callee string"), "files": spark.createDataFrame(files, "path string, content string"), "mapping": spark.createDataFrame(mapping, "identity string, status string, role string, component string"),
    }


def test_creation_from_odd_seeds(spark):
    symbols = [("F", "class", "F", None), ("F::Create", "method", "F::Create", "F"), ("M", "class", "M", None), ("M::Make", "method", "M::Make", "M"), ("in", "function", "in", None), ("V", "class", "V", None), ("ref", "function", "Ref", None)]
    ranges = [(s[0], "declaration", "f.h", i, 1, i, 2) for i, s in enumerate(symbols[:6], 1)] + [("M::Make", "definition", "m.cpp", 1, 1, 1, 2), ("ref", "declaration", "r.h", 1, 1, 1, 2)]
    files = [("m.cpp", "Make(int v)\n{\n  F::Create(Ref<V>());\n}\n"), ("r.h", "Ref() {}\n")]
    # the parts of line 3: two blanks, F::, Create, (Ref<, V
    references = [("F::Create", "m.cpp", 3, 6, 3, 12), ("V", "m.cpp", 3, 17, 3, 18)]
    world = tables(spark, symbols, ranges, references, [("in", "M::Make"), ("M::Make", "F::Create"), ("M::Make", "ref"), ("M::Make", "in")], files, [("M", "recognized", "model", "c"), ("V", "recognized", "pattern", "c")])
    pattern = "\\(int v\\)\\s*\\{\\s*F::)(Create)(\\(Ref<)(\\w+)>\\(\\)\\);"
    found = creation_trace.creation_traces(
        spark.createDataFrame([("plain", "in", "c"), ("frame", "F::Create", "c"), ("lost", "nowhere", "c"), ("other", "in", "zz")], "trace string, seed string, component string"), **world, components=spark.createDataFrame([("c",)], "component string"),
        factories=spark.createDataFrame([("Ref", "r.h", "^Ref\\(\\) \\{\\}")], "qualified_name string, file_path string, pattern string"), frames=creation_trace.Frames("F", "f.h", ("Create",)), pattern=pattern,
    )
    got = {r.trace: (r.path, r.stages, r.pattern, r.gaps) for r in found.paths.collect()}
    summary = {r.trace: (r.status, r.diagnostics) for r in found.summary.collect()}
    assert got["plain"] == (["in", "M::Make", "F::Create"], ["entry", "model", "frame_node"], "V", [])
    assert summary["plain"] == ("incomplete", "cycle_cut")
    assert got["frame"] == (["F::Create"], ["frame_node"], None, ["missing_entry_call", "missing_entry_stage", "missing_model_stage", "missing_pattern_stage"])
    assert got["lost"] == (["nowhere"], ["entry"], None, ["missing_creation_relation", "missing_node", "missing_pattern_stage"]) and summary["lost"][0] == "incomplete"
    assert got["other"][3] == ["missing_creation_relation", "missing_pattern_stage"] and summary["other"] == ("incomplete", "unknown_component")


def test_layout_bounds_cut_by_order(spark):
    rows = spark.createDataFrame([("t", k) for k in "cabd"] + [("u", "x"), ("u", "x")], "trace string, node string")
    kept, over = layout_trace.limited(rows, "factory", 2)
    assert sorted(map(tuple, kept.collect())) == [("t", "a"), ("t", "b"), ("u", "x")]
    assert [tuple(r) for r in over.collect()] == [("t", "factory_candidate_limit")]


def test_layout_from_odd_seeds_and_limits_of_calls(spark):
    symbols = [("P", "class", "P", None), ("P::Fac", "method", "P::Fac", "P"), ("A", "class", "A", None), ("A::Measure", "method", "A::Measure", "A"), ("A::Layout", "method", "A::Layout", "A"), ("Q", "class", "Q", None), ("N", "class", "N", None)]
    ranges = [("P::Fac", "definition", "p.cpp", 1, 1, 1, 2), ("A::Measure", "definition", "p.cpp", 2, 1, 2, 2), ("A::Layout", "definition", "p.cpp", 3, 1, 3, 2)]
    files = [("p.cpp", "Fac() { return New<A>(); }\nMeasure() { use N; }\nLayout();\n")]
    references = [("A", "p.cpp", 1, 20, 1, 21), ("N", "p.cpp", 2, 17, 2, 18)]
    mapping = [("P", "recognized", "pattern", "c"), ("A", "recognized", "layout_algorithm", "c"), ("Q", "ambiguous", None, None), ("N", "recognized", "layout_property", "c")]
    world = tables(spark, symbols, ranges, references, [("P::Fac", x) for x in "xyz"], files, mapping)
    relations = spark.createDataFrame([("P::Fac", "A", "create"), ("A", "A::Measure", "measure"), ("A", "A::Layout", "layout")], "source string, target string, relation string")
    idioms = layout_trace.Idioms("Fac", "\\(\\)\\s*\\{\\s*return [^;{}]*;\\s*\\}", "New<", "use )(\\w+);")
    requests = spark.createDataFrame([("plain", "P", "c"), ("none", "Z", "c"), ("vague", "Q", "c"), ("role", "N", "c"), ("other", "P", "d")], "trace string, seed string, component string")
    found = layout_trace.layout_traces(requests, **world, relations=relations, idioms=idioms, max_calls=2)
    got = {r.trace: (r.status, r.exhaustive, r.gaps) for r in found.summary.collect()}
    assert got == {
        "plain": ("incomplete", False, "support_call_limit,unsupported_layout_implementation"), "none": ("incomplete", True, "missing_seed"), "vague": ("ambiguous", True, "ambiguous_pattern_role"),
        "role": ("ambiguous", True, "ambiguous_pattern_role_conflict"), "other": ("incomplete", True, "unknown_or_cross_component_pattern"),
    }
    assert {(r.stage, r.node) for r in found.stages.where("trace = 'plain'").collect()} == {("pattern", "P"), ("factory", "P::Fac"), ("algorithm", "A"), ("measure", "A::Measure"), ("layout_property", "N")}
    assert [r.callee for r in found.calls.orderBy("callee").collect()] == ["x", "y"]
