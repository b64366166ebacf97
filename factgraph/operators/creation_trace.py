"""Traces of component creation: from entries through models to the frame that is made, with the pattern it is made with.

Calls make the paths; the pattern is proved by the text of the call's arguments, the references at exactly these places and
the one allocation that the caller calls. Tables are those of factgraph.operators.framework.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import framework, walks
from factgraph.sources.workspace import written


@dataclass(frozen=True)
class Frames:
    """The class whose methods make frames, the file it and they must be declared in, and its factories; those of ``callback`` take the pattern from a callback."""

    qualified_name: str
    file_path: str
    factories: tuple[str, ...]
    callback: tuple[str, ...] = ()


@dataclass(frozen=True)
class CreationTraces:
    """paths: trace, state, path (from the seed on), stages (of each node), pattern (proved, else null), gaps; summary: see walks.summed."""

    paths: DataFrame
    summary: DataFrame


def frame_symbols(symbols: DataFrame, symbol_ranges: DataFrame, frames: Frames) -> DataFrame:
    """node, name of the factories that the index knows in the file they must be declared in."""
    c = F.col
    declared = symbol_ranges.where((c("role") == "declaration") & (c("file_path") == frames.file_path)).select(c("symbol_identity").alias("identity")).distinct()
    # a class's definition says where it is, or else its declaration
    place = symbol_ranges.groupBy(c("symbol_identity").alias("identity")).agg(F.max_by("file_path", c("role") == "definition").alias("file_path"))
    owner = symbols.where((c("kind") == "class") & (c("qualified_name") == frames.qualified_name)).select("identity").join(place.where(c("file_path") == frames.file_path), "identity", "left_semi").select(c("identity").alias("parent_identity"))
    wanted = [f"{frames.qualified_name}::{n}" for n in (*frames.factories, *frames.callback)]
    own = framework.names(symbols).where((c("kind") == "method") & c("qualified_name").isin(*wanted))
    return own.join(owner, "parent_identity", "left_semi").join(declared, "identity", "left_semi").select(c("identity").alias("node"), "name")


def arguments(made: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, calls: DataFrame, files: DataFrame, mapping: DataFrame, factories: DataFrame, pattern: str, frames: Frames) -> DataFrame:
    """scope, caller, frame, pattern (proved, else null) and gap of the calls (scope, component, caller, frame, name) that make frames.

    pattern: of a body from its parameters on, with the groups in front of the frame's factory, the factory, between, the pattern.
    """
    c = F.col
    pairs = made.select("caller", "frame", "name").distinct()
    own = framework.names(symbols).select(c("identity").alias("caller"), c("name").alias("own_name"))
    defined = symbol_ranges.where("role = 'definition'").select(c("symbol_identity").alias("caller"), "file_path", "start_line", "start_column")
    seen = framework.windows(pairs.join(own, "caller").join(defined, "caller"), files).withColumn("_p", F.concat(F.lit("^(\\Q"), "own_name", F.lit("\\E" + pattern)))
    hit = seen.where("window rlike _p").select("caller", "frame", "file_path", "start_line", "start_column", *(F.expr(f"regexp_extract(window, _p, {n})").alias(f"g{n}") for n in (1, 2, 3, 4)))
    hit = written(hit.withColumn("call", F.concat_ws("\x1f", "caller", "frame")))
    spot = lambda before, target: hit.select("call", "file_path", "start_line", "start_column", before.alias("before"), target.alias("target"))
    frame_refs = framework.referred(spot(c("g1"), c("g2")), references, "call").select("call", c("refs").alias("frame_refs"), c("ref").alias("frame_ref"))
    pattern_refs = framework.referred(spot(F.concat("g1", "g2", "g3"), c("g4")), references, "call").select("call", c("refs").alias("pattern_refs"), c("ref").alias("pattern"))
    proved = framework.proved_factories(symbols, symbol_ranges, files, factories).select(c("identity").alias("callee"))
    allocated = calls.join(proved, "callee", "left_semi").groupBy("caller").agg(F.count_distinct("callee").alias("allocations"))
    rows = pairs.join(defined.select("caller", F.lit(True).alias("defined")).distinct(), "caller", "left").join(hit.select("caller", "frame", "call"), ["caller", "frame"], "left")
    rows = rows.join(frame_refs, "call", "left").join(pattern_refs, "call", "left").join(allocated, "caller", "left").drop("name")
    goal = mapping.select(c("identity").alias("pattern"), "status", c("role").alias("goal_role"), c("component").alias("goal_component"))
    rows = made.join(rows, ["caller", "frame"]).join(goal, "pattern", "left")
    lacks = (c("frame_refs").isNull()) | (c("frame_ref") != c("frame")) | c("pattern_refs").isNull()
    gap = (
        F.when(c("defined").isNull(), "missing_definition").when(c("name").isin(*frames.callback) if frames.callback else F.lit(False), "unsupported_pattern_callback").when(c("call").isNull(), "unsupported_pattern_argument")
        .when((c("frame_refs") > 1) | (c("pattern_refs") > 1), "ambiguous_reference").when(lacks, "missing_argument_reference").when(c("allocations").isNull(), "missing_allocation_call").when(c("allocations") > 1, "ambiguous_allocation_call")
        .when(c("status") == "ambiguous", "ambiguous_role").when(c("status").isNull() | (c("status") != "recognized"), "unknown_pattern_role")
        .when(~F.coalesce((c("goal_role") == "pattern") & (c("goal_component") == c("component")), F.lit(False)), "different_component_or_role")
    )
    return rows.select("scope", "caller", "frame", F.when(gap.isNull(), c("pattern")).alias("pattern"), gap.alias("gap"))


def creation_traces(requests: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, calls: DataFrame, files: DataFrame, mapping: DataFrame, components: DataFrame, factories: DataFrame, frames: Frames, pattern: str, max_depth: int = 8, max_paths: int = 32, max_states: int = 1000) -> CreationTraces:
    """Traces of all requests (trace, seed, component) at once; components: component, the catalog, whose size bounds the components asked for.

    Stages: frame_node, model, bridge, entry (the seed, if it is none of these), support. Gaps besides those of
    ``arguments``: missing_node, missing_source_location, ambiguous_role, different_component (the path ends there),
    missing_entry_stage, missing_model_stage, missing_entry_call, missing_creation_relation, missing_pattern_stage.
    """
    c = F.col
    requests = written(requests.select("trace", "seed", "component", c("component").alias("scope")))
    # distinct components of the requests; the catalog of a code base has some hundred
    scopes = requests.select("scope", "component").distinct()
    makers = written(frame_symbols(symbols, symbol_ranges, frames))
    edges = written(calls.select(c("caller").alias("src"), c("callee").alias("dst")).distinct())
    of = mapping.select(c("identity").alias("parent_identity"), "status", "role", c("component").alias("of"))
    placed = symbol_ranges.select(c("symbol_identity").alias("node"), F.lit(True).alias("placed")).distinct()
    known = symbols.select(c("identity").alias("node"), "parent_identity").join(of, "parent_identity", "left").join(makers.select("node", F.lit(True).alias("frame")), "node", "left").join(placed, "node", "left")
    known = written(known)
    strange = (c("status") == "recognized") & ~c("of").eqNullSafe(c("component"))
    issue = F.when(c("frame"), None).when(c("status") == "ambiguous", "ambiguous_role").when(strange, "different_component")
    stage = F.when(c("frame"), "frame_node").when((c("status") == "recognized") & ~strange & c("role").isin("model", "bridge"), c("role")).otherwise("support")
    # searches start backwards from models of the component, from frames and from what can't be told
    clear = known.where("frame or status = 'ambiguous'").select("node")
    targets = known.where("frame is null and status = 'recognized' and role = 'model'").join(scopes, c("of") == c("component")).select("scope", "node")
    targets = targets.union(clear.withColumn("scope", F.explode(F.lit(sorted(r[0] for r in scopes.select("scope").collect())).cast("array<string>"))).select("scope", "node"))
    # classes of another component aren't passed
    other = written(known.where("frame is null and status = 'recognized'").select("node", F.coalesce("of", F.lit("\x00no component")).alias("of")))
    steps_of = edges.join(other.select(c("node").alias("src"), "of"), "src", "left")
    scoped = steps_of.where("of is null").select(F.lit(None).cast("string").alias("only"), "src", "dst").union(steps_of.where("of is not null").select(c("of").alias("only"), "src", "dst"))
    near = written(_relevant(scoped, targets))
    steps = edges.join(near.withColumnRenamed("node", "dst"), "dst").select("scope", "src", "dst")
    met = near.union(requests.select("scope", c("seed").alias("node"))).distinct().join(scopes, "scope").join(known, "node", "left")
    lost = F.when(c("missing"), "missing_node").when(c("placed").isNull(), "missing_source_location")
    met = met.join(symbols.select(c("identity").alias("node"), F.lit(False).alias("missing")), "node", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    flags = written(met.select("scope", "node", "component", F.coalesce("frame", F.lit(False)).alias("ends"), stage.alias("stage"), F.array_compact(F.array(issue, lost)).alias("issues")).withColumn("blocked", F.size("issues") > 0))
    found = walks.walk(steps, requests.select("trace", "scope", c("seed").alias("node")), flags.where("ends or blocked").withColumn("weight", F.lit(1)), max_depth, max_paths, max_states)
    made = written(steps.join(makers.withColumnRenamed("node", "dst"), "dst").select("scope", c("scope").alias("component"), c("src").alias("caller"), c("dst").alias("frame"), "name"))
    proofs = arguments(made, symbols, symbol_ranges, references, calls, files, mapping, factories, pattern, frames)
    nodes = found.paths.select("trace", "scope", "state", F.posexplode("path").alias("at", "node")).join(flags.select("scope", "node", "stage", "issues"), ["scope", "node"])
    named = F.when((c("at") == 0) & (c("stage") == "support"), "entry").otherwise(c("stage"))
    staged = nodes.groupBy("trace", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", named.alias("stage")))), lambda s: s["stage"]).alias("stages"), F.flatten(F.collect_list("issues")).alias("issues"))
    rows = found.paths.join(staged, ["trace", "state"]).withColumn("frame", F.when(c("ended"), F.element_at("path", -1))).withColumn("caller", F.when(c("ended") & (c("length") > 0), F.expr("element_at(path, -2)")))
    rows = rows.join(proofs, ["scope", "caller", "frame"], "left")
    at_frame = F.array_compact(F.array(
        F.when(c("stages")[0].isin("model", "frame_node"), "missing_entry_stage"), F.when(~F.array_contains("stages", "model"), "missing_model_stage"), F.when(c("length") == 0, "missing_entry_call"), c("gap"),
    ))
    gaps = F.concat("issues", F.when(c("ended"), at_frame).otherwise(F.array(F.lit("missing_creation_relation"))), F.array_compact(F.array(F.when(c("pattern").isNull(), "missing_pattern_stage"))))
    paths = written(rows.select("trace", "state", "path", "stages", "pattern", F.array_sort(F.array_distinct(gaps)).alias("gaps")))
    unknown = requests.join(components.select("component").distinct(), "component", "left_anti").select("trace", F.lit("unknown_component").alias("issue"))
    return CreationTraces(paths, walks.summed(paths, found.notes.union(unknown), requests))


def _relevant(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """scope and node of what a target can be reached from; a step (only, src, dst) with a component counts for that one alone."""
    found = fresh = written(targets.distinct())
    while True:
        back = steps.join(fresh.withColumnRenamed("node", "dst"), "dst").where("only is null or only = scope").select("scope", F.col("src").alias("node")).distinct()
        fresh = written(back.join(found, ["scope", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.union(fresh)
