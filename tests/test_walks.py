from __future__ import annotations

import random

import pytest

from factgraph.operators import framework, property_trace, snippets, walks

STEPS, FLAGS = "scope string, src string, dst string", "scope string, node string, ends boolean, blocked boolean, weight long"


def by_stack(steps, seed, flags, max_depth, max_paths, max_states):
    """Paths with the weight in front of them, and issues, as a depth-first search with a stack finds them."""
    stack, out, states, held, issues = [(seed,)], [], 0, 0, set()
    while stack:
        if states >= max_states or held >= max_paths:
            issues.add("state_or_path_limit")
            break
        path = stack.pop()
        states += 1
        ends, blocked, weight = flags.get(path[-1], (False, False, 1))
        onward = sorted({d for s, d in steps if s == path[-1]})
        fresh = [d for d in onward if d not in path]
        if not ends and not blocked and len(path) - 1 < max_depth:
            if len(fresh) < len(onward):
                issues.add("cycle_cut")
            stack += [(*path, d) for d in reversed(fresh)]
            if fresh:
                continue
        if not ends and onward and len(path) - 1 == max_depth:
            issues.add("depth_limit")
        out.append((path, ends, held))
        held += weight
    return out, issues


@pytest.mark.parametrize("seed", range(4))
def test_walks_from_many_starts(spark, seed):
    rng = random.Random(seed)
    scopes = {s: list({(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(rng.randint(6, 16))}) for s in ("s", "t")}
    flags = {s: {k: (rng.random() < 0.5, rng.random() < 0.3, rng.randint(1, 3)) for k in rng.sample("abcdefg", 3)} for s in scopes}
    starts = [(f"{s}{k}", s, k) for s in scopes for k in "abcz"]
    limits = rng.randint(0, 4), rng.randint(1, 8), rng.randint(1, 12)
    got = walks.walk(
        spark.createDataFrame([(s, a, b) for s, e in scopes.items() for a, b in e], STEPS), spark.createDataFrame(starts, "trace string, scope string, node string"),
        spark.createDataFrame([(s, k, *f) for s, own in flags.items() for k, f in own.items()], FLAGS), *limits,
    )
    paths, notes = {}, {}
    for r in got.paths.orderBy("trace", "state").collect():
        paths.setdefault(r.trace, []).append((tuple(r.path), r.ended, r.before))
        assert r.length == len(r.path) - 1
    for r in got.notes.collect():
        notes.setdefault(r.trace, set()).add(r.issue)
    for trace, scope, key in starts:
        want, issues = by_stack(scopes[scope], key, flags[scope], *limits)
        assert (paths.get(trace, []), notes.get(trace, set())) == (want, issues)


def test_statuses_of_traces(spark):
    paths = spark.createDataFrame([(1, []), (2, ["missing_x"]), (3, ["ambiguous_x"]), (4, []), (4, []), (5, [])], "trace long, gaps array<string>")
    notes = spark.createDataFrame([(5, "depth_limit"), (5, "cycle_cut"), (6, "unknown_component")], "trace long, issue string")
    got = {r.trace: (r.status, r.exhaustive, r.diagnostics, r.n_paths) for r in walks.summed(paths, notes, spark.range(1, 7).withColumnRenamed("id", "trace")).collect()}
    assert got == {
        1: ("complete", True, "", 1), 2: ("incomplete", True, "", 1), 3: ("ambiguous", True, "", 1), 4: ("ambiguous", True, "", 2),
        5: ("incomplete", False, "cycle_cut,depth_limit", 1), 6: ("incomplete", False, "unknown_component", 0),
    }


def test_line_offsets_of_awkward_files(spark):
    files = {"a": "", "b": "x", "c": "x\n", "d": "\n\né\nyy", "e": "\n" * 5}
    got = {}
    for r in snippets.line_offsets(spark.createDataFrame(list(files.items()), "path string, content string")).orderBy("path", "line").collect():
        got.setdefault(r.path, []).append(r.offset)
    for path, text in files.items():
        starts, at = [0], 0
        for line in text.split("\n"):
            at += len(line) + 1
            if at <= len(text):
                starts.append(at)
        assert got[path] == starts


CODE = "Set(int v)\n{\n  PUT(P, Width, v);\n}\n"
PROP = "UpdateWidth(int v)\n{\n  width_ = v;\n}\nGet()\n{\n  return width_;\n}\nTwo()\n{\n  return width_;\n}\n"


def world(spark, calls, extra_references=(), state_kind="field"):
    symbols = [
        ("M", "class", "M", None), ("set", "method", "M::Set", "M"), ("P", "class", "P", None), ("write", "method", "P::UpdateWidth", "P"), ("get", "method", "P::Get", "P"), ("two", "method", "P::Two", "P"),
        ("width", state_kind, "P::width_", "P"), ("other", "field", "P::other", "P"), ("use", "function", "use", None), ("X", "class", "X", None), ("cross", "method", "X::f", "X"), ("A", "class", "A", None), ("vague", "method", "A::f", "A"), ("in", "function", "in", None),
    ]
    spot = "symbol_identity string, {}file_path string, start_line long, start_column long, end_line long, end_column long"
    ranges = [("set", "definition", "m.cpp", 1, 1, 1, 2), *((s, "definition", "p.cpp", n, 1, n, 2) for s, n in (("write", 1), ("get", 5), ("two", 9)))]
    ranges += [(s[0], "declaration", "all.h", i, 1, i, 2) for i, s in enumerate(symbols, 1)]
    references = [("P", "m.cpp", 3, 7, 3, 8), ("width", "p.cpp", 3, 3, 3, 9), ("width", "p.cpp", 7, 10, 7, 16), ("width", "p.cpp", 11, 10, 11, 16), *extra_references]
    mapping = [("M", "recognized", "model", "c"), ("P", "recognized", "layout_property", "c"), ("X", "recognized", "bridge", "d"), ("A", "ambiguous", None, None)]
    return {
        "symbols": spark.createDataFrame(symbols, "identity string, kind string, qualified_name string, parent_identity string"), "symbol_ranges": spark.createDataFrame(ranges, spot.format("role string, ")),
        "references": spark.createDataFrame(references, spot.format("")), "calls": spark.createDataFrame(calls, "caller string, callee string"), "files": spark.createDataFrame([("m.cpp", CODE), ("p.cpp", PROP)], "path string, content string"),
        "mapping": spark.createDataFrame(mapping, "identity string, status string, role string, component string"),
    }


def traced(spark, tables, requests, **limits):
    found = property_trace.property_traces(
        spark.createDataFrame(requests, "trace string, seed string, setter string, component string"), **tables, updates=spark.createDataFrame([("set", "P")], "source string, target string"),
        templates=[("put", "PUT\\()(\\w+), (\\w+), \\w+\\);", "layout_property")], components=spark.createDataFrame([("c",), ("d",)], "component string"), **limits,
    )
    paths = {}
    for r in found.paths.orderBy("trace", "state", "tail").collect():
        paths.setdefault(r.trace, []).append((">".join(r.path), ">".join(r.chain), r.gaps))
    return paths, {r.trace: (r.status, r.diagnostics) for r in found.summary.collect()}


def test_property_traces_of_one_setter(spark):
    calls = [("in", "set"), ("cross", "set"), ("vague", "set"), ("set", "write"), ("use", "get")]
    requests = [("plain", "in", "set", "c"), ("self", "set", "set", "c"), ("cross", "cross", "set", "c"), ("vague", "vague", "set", "c"), ("lost", "use", "set", "c"), ("none", "in", "set", "zz")]
    paths, summary = traced(spark, world(spark, calls), requests)
    chain = "P>write>width>get>use"
    assert paths["plain"] == [("in>set", chain, [])] and summary["plain"] == ("complete", "")
    assert paths["self"] == [("set", chain, ["missing_entry_call"])]
    assert paths["cross"] == [("cross", "", ["cross_component_call", "missing_setter_call"])]
    assert paths["vague"] == [("vague", "", ["ambiguous_call_role", "missing_setter_call"])] and summary["vague"][0] == "ambiguous"
    assert paths["lost"] == [("use", "", ["missing_setter_call"])]
    assert paths["none"] == [("in>set", "", ["cross_component_call", "unknown_or_cross_component_model", "unknown_or_cross_component_property"])] and summary["none"] == ("incomplete", "unknown_component")


def test_tails_share_the_limit_of_paths(spark):
    calls = [("in", "set"), ("set", "write"), ("use", "get"), ("use", "two"), ("cross", "two")]
    paths, summary = traced(spark, world(spark, calls), [("t", "in", "set", "c")])
    assert [p[1] for p in paths["t"]] == ["P>write>width>get>use", "P>write>width>two>cross", "P>write>width>two>use"] and summary["t"] == ("ambiguous", "")
    paths, summary = traced(spark, world(spark, calls), [("t", "in", "set", "c")], max_paths=2)
    assert len(paths["t"]) == 2 and summary["t"] == ("ambiguous", "path_limit")


def test_states_that_can_not_be_told(spark):
    calls = [("in", "set"), ("set", "write"), ("use", "get")]
    paths, _ = traced(spark, world(spark, calls, [("other", "p.cpp", 3, 3, 3, 9)]), [("t", "in", "set", "c")])
    assert paths["t"] == [("in>set", "P>write", ["ambiguous_state_identity"])]
    paths, _ = traced(spark, world(spark, calls, [("other", "p.cpp", 7, 10, 7, 16)]), [("t", "in", "set", "c")])
    assert paths["t"] == [("in>set", "P>write>width>get>use", ["ambiguous_state_identity"])]
    paths, _ = traced(spark, world(spark, calls, state_kind="method"), [("t", "in", "set", "c")])
    assert paths["t"] == [("in>set", "P>write", ["unsupported_property_state"])]


def test_targets_stand_where_the_text_says(spark):
    rows = spark.createDataFrame([("k", "f", 4, 5, "ab(", "xy"), ("l", "f", 4, 5, "ab\n c(", "xy"), ("m", "f", 4, 5, None, None)], "key string, file_path string, start_line long, start_column long, before string, target string")
    got = {r.key: (r.at_line, r.at_column, r.at_end) for r in framework.target_range(rows.where("target is not null")).collect()}
    assert got == {"k": (4, 8, 10), "l": (5, 4, 6)}
