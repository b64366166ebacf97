"""Traces of property updates: from entries to a setter, and from it through writer, state and reader to the consumers.

The two halves are found apart and meet at the setter: the calls that lead to it, and its tails, each a chain from the
property class on. A path that reaches the setter is one path for each tail, as far as the limit of paths allows. Tables are
those of factgraph.operators.framework; names and texts only corroborate what calls and references say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators import framework, walks
from factgraph.sources.workspace import written

#: Bodies that write a parameter to a field, and that return a field; fixed values.
WRITE = "(\\([\\w:&*<> ]+\\s+(\\w+)\\)\\s*(?:const\\s*)?\\{\\s*)(\\w+)\\s*=\\s*\\2\\s*;\\s*\\}"
READ = "(\\(\\s*\\)\\s*(?:const\\s*)?\\{\\s*return\\s+)(\\w+)\\s*;\\s*\\}"


@dataclass(frozen=True)
class PropertyTraces:
    """paths: trace, state, tail, path (from the seed to the last call), chain (nodes of the tail), binding, gaps; summary: see walks.summed."""

    paths: DataFrame
    summary: DataFrame


def _gaps(*gaps):
    return F.array_compact(F.array(*gaps))


def bindings(scopes: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, files: DataFrame, mapping: DataFrame, updates: DataFrame, templates: list[tuple[str, str, str]]) -> DataFrame:
    """scope, setter, component, token, binding (the property class, if proved) and gaps (why not) of setters (scope, setter, component).

    templates: name, pattern (of a setter's body; groups: before the target, target, token) and the role that the target must
    have, for each of a few idioms; updates: source and target of proved update relations.
    """
    c = F.col
    own = framework.names(symbols).select(c("identity").alias("setter"), "name", c("parent_identity").alias("owner"))
    roles = mapping.select("identity", "status", "role", c("component").alias("of"))
    rows = scopes.join(own, "setter", "left").join(roles.select(c("identity").alias("owner"), c("status").alias("owner_status"), c("role").alias("owner_role"), c("of").alias("owner_of")), "owner", "left")
    defined = symbol_ranges.where("role = 'definition'").select(c("symbol_identity").alias("setter"), "file_path", "start_line", "start_column")
    idioms = F.array(*(F.struct(F.lit(pattern).alias("pattern"), F.lit(role).alias("expected")) for _, pattern, role in templates))
    seen = framework.windows(rows.join(defined, "setter"), files).withColumn("idiom", F.explode(idioms)).select("*", "idiom.*")
    seen = seen.withColumn("_p", F.concat(F.lit("^(\\Q"), "name", F.lit("\\E" + framework.PARAMETERS), "pattern", F.lit("\\s*\\}"))).where("window rlike _p")
    hit = written(seen.select("scope", "file_path", "start_line", "start_column", "expected", *(F.expr(f"regexp_extract(window, _p, {n})").alias(a) for n, a in ((1, "before"), (2, "target"), (3, "token")))))
    refs = framework.referred(hit, references, "scope")
    goal = roles.select(c("identity").alias("ref"), c("status").alias("goal_status"), c("role").alias("goal_role"), c("of").alias("goal_of"))
    proved = updates.select(c("source").alias("setter"), c("target").alias("ref"), F.lit(True).alias("proved")).distinct()
    rows = rows.join(hit.select("scope", "expected", "token"), "scope", "left").join(refs, "scope", "left").join(goal, "ref", "left").join(proved, ["setter", "ref"], "left")
    known = c("goal_status") == "recognized"
    model = F.when(c("owner_status") == "ambiguous", "ambiguous_model_role").when(~F.coalesce((c("owner_status") == "recognized") & (c("owner_role") == "model") & (c("owner_of") == c("component")), F.lit(False)), "unknown_or_cross_component_model")
    aim = F.when(c("token").isNull(), None).when(c("refs") > 1, "ambiguous_property_identity").when(c("refs").isNull(), "missing_property_reference").when(c("goal_status") == "ambiguous", "ambiguous_property_role")
    aim = aim.when(known & (c("goal_role") != c("expected")), "ambiguous_property_role_conflict").when(~F.coalesce(known & (c("goal_of") == c("component")), F.lit(False)), "unknown_or_cross_component_property")
    rows = rows.withColumn("gaps", _gaps(model, aim)).withColumn("binding", F.when((F.size("gaps") == 0) & c("proved"), c("ref")))
    rows = rows.withColumn("gaps", F.when((F.size("gaps") == 0) & c("binding").isNull(), F.array(F.lit("missing_update_binding"))).otherwise(c("gaps")))
    return written(rows.select("scope", "setter", "component", "token", "binding", "gaps"))


def tails(bound: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """scope, tail (number, in order), chain (property class, writer, state, reader, consumer, as far as it goes) and gaps of bound setters."""
    c = F.col
    own = framework.names(symbols).select("identity", "kind", "name", c("parent_identity").alias("owner"))
    bound = bound.where("binding is not null").select("scope", "setter", "token", "binding")
    methods = own.where("kind = 'method'")
    writers = calls.select(c("caller").alias("setter"), c("callee").alias("writer")).distinct().join(methods.select(c("identity").alias("writer"), c("name").alias("wname"), "owner"), "writer")
    led = written(bound.join(writers, (bound["setter"] == writers["setter"]) & (c("owner") == c("binding")) & (c("wname") == F.concat(F.lit("Update"), "token")), "left").drop(writers["setter"]))
    defined = symbol_ranges.where("role = 'definition'").select(c("symbol_identity").alias("method"), "file_path", "start_line", "start_column")

    def fields(rows: DataFrame, pattern: str, group: int) -> DataFrame:
        """method, owner, refs and candidates of the field in the bodies of methods (method, owner, name) that match."""
        seen = framework.windows(rows.join(defined, "method"), files).withColumn("_p", F.concat(F.lit("^(\\Q"), "name", F.lit("\\E"), F.lit(pattern[1:]))).where("window rlike _p")
        hit = seen.select("method", "file_path", "start_line", "start_column", F.expr("regexp_extract(window, _p, 1)").alias("before"), F.expr(f"regexp_extract(window, _p, {group})").alias("target"))
        refs = framework.referred(hit, references, "method")
        return written(rows.join(refs, "method").select("method", "owner", "refs", "candidates"))

    wrote = fields(led.where("writer is not null").select(c("writer").alias("method"), c("binding").alias("owner"), c("wname").alias("name")).distinct(), WRITE, 3)
    rows = led.join(wrote.select(c("method").alias("writer"), "refs", "candidates"), "writer", "left").withColumn("state", F.when(c("refs") == 1, c("candidates")[0]))
    rows = rows.join(own.select(c("identity").alias("state"), c("kind").alias("state_kind"), c("owner").alias("state_owner")), "state", "left")
    problem = (
        F.when(c("writer").isNull(), "missing_property_writer").when(c("refs") > 1, "ambiguous_state_identity").when(c("refs").isNull(), "unsupported_property_write")
        .when(~F.coalesce((c("state_kind") == "field") & (c("state_owner") == c("binding")), F.lit(False)), "unsupported_property_state")
    )
    rows = written(rows.withColumn("problem", problem))
    good = rows.where("problem is null").select("scope", "setter", "binding", "writer", "state")
    read = fields(methods.join(good.select(c("binding").alias("owner")).distinct(), "owner").select(c("identity").alias("method"), "owner", "name"), READ, 2)
    readers = read.select(c("method").alias("reader"), c("owner").alias("binding"), "refs", F.explode("candidates").alias("state"))
    used = calls.select(c("callee").alias("reader"), c("caller").alias("consumer")).distinct()
    met = good.join(readers, ["binding", "state"]).join(used, "reader").where("consumer <> setter and consumer <> writer and consumer <> reader")
    ends = good.join(met.select("scope", "writer", "reader", "consumer", "refs"), ["scope", "writer"], "left")
    note = F.when(c("reader").isNull(), "missing_downstream_consumer").when(c("refs") > 1, "ambiguous_state_identity")
    chain = lambda *names: F.array_compact(F.array(*map(F.col, names)))
    done = ends.select("scope", "writer", "reader", "consumer", chain("binding", "writer", "state", "reader", "consumer").alias("chain"), _gaps(note).alias("gaps"))
    null = F.lit(None).cast("string")
    cut = rows.where("problem is not null").select("scope", "writer", null.alias("reader"), null.alias("consumer"), chain("binding", "writer").alias("chain"), _gaps(c("problem")).alias("gaps"))
    order = Window.partitionBy("scope").orderBy("writer", "reader", "consumer")
    return done.union(cut).withColumn("tail", F.row_number().over(order) - 1).select("scope", "tail", "chain", "gaps")


def property_traces(requests: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, calls: DataFrame, files: DataFrame, mapping: DataFrame, updates: DataFrame, templates: list[tuple[str, str, str]], components: DataFrame, max_depth: int = 8, max_paths: int = 32, max_states: int = 1000) -> PropertyTraces:
    """Traces of all requests (trace, seed, setter, component) at once; components: component, the catalog.

    Gaps: those of bindings and tails, missing_entry_call (the seed is the setter), ambiguous_call_role and
    cross_component_call (a caller's class has two roles or another component), missing_setter_call (a path that ends
    elsewhere), missing_source_location. Diagnostics: those of walks.walk, path_limit (tails left out), unknown_component.
    """
    c = F.col
    scope = F.concat_ws("\x1f", "setter", "component")
    requests = written(requests.select("trace", "seed", "setter", "component", scope.alias("scope")))
    scopes = requests.select("scope", "setter", "component").distinct()
    bound = bindings(scopes, symbols, symbol_ranges, references, files, mapping, updates, templates)
    ended = written(tails(bound, symbols, symbol_ranges, references, calls, files))
    edges = written(calls.select(c("caller").alias("src"), c("callee").alias("dst")).distinct())
    near = walks.reaching(edges, scopes.select("scope", c("setter").alias("node")))
    steps = edges.join(near.withColumnRenamed("node", "dst"), "dst").select("scope", "src", "dst")
    # what stands against a caller: the role of its class
    of = mapping.where("status = 'ambiguous' or status = 'recognized'").select(c("identity").alias("parent_identity"), "status", c("component").alias("of"))
    owned = symbols.select(c("identity").alias("node"), "parent_identity").join(of, "parent_identity").select("node", "status", "of")
    reached = near.union(requests.select("scope", c("seed").alias("node"))).distinct().join(scopes, "scope").join(owned, "node", "left")
    wrong = F.when(c("status") == "ambiguous", "ambiguous_call_role").when((c("status") == "recognized") & (c("of") != c("component")), "cross_component_call")
    n_tails = ended.groupBy("scope").agg(F.count("*").alias("n_tails"))
    flags = reached.join(n_tails, "scope", "left").select("scope", "node", (c("node") == c("setter")).alias("ends"), wrong.isNotNull().alias("blocked"), F.when(c("node") == c("setter"), F.coalesce("n_tails", F.lit(1))).otherwise(1).alias("weight"), wrong.alias("wrong"))
    flags = written(flags)
    found = walks.walk(steps, requests.select("trace", "scope", c("seed").alias("node")), flags.where("ends or blocked"), max_depth, max_paths, max_states)
    last = flags.select("scope", c("node").alias("last"), "wrong")
    rows = found.paths.withColumn("last", F.element_at("path", -1)).join(last, ["scope", "last"], "left").join(bound.select("scope", "binding", c("gaps").alias("binding_gaps")), "scope", "left")
    rows = rows.join(ended.select("scope", "tail", "chain", c("gaps").alias("tail_gaps"), F.lit(True).alias("ended")), ["scope", "ended"], "left")
    none = F.array().cast("array<string>")
    whole = rows.withColumn("tail", F.coalesce("tail", F.lit(0))).withColumn("chain", F.coalesce("chain", none))
    cut = whole.where(c("before") + c("tail") >= max_paths).select("trace", F.lit("path_limit").alias("issue"))
    whole = written(whole.where(c("before") + c("tail") < max_paths))
    # a path's nodes without a source place
    placed = symbol_ranges.select(c("symbol_identity").alias("node"), F.lit(True).alias("placed")).distinct()
    loose = whole.where("ended").select("trace", "state", "tail", F.explode(F.concat("path", "chain")).alias("node")).join(placed, "node", "left").where("placed is null").select("trace", "state", "tail").distinct().withColumn("loose", F.lit(True))
    whole = whole.join(loose, ["trace", "state", "tail"], "left")
    ends = F.concat(_gaps(c("wrong"), F.when(c("length") == 0, "missing_entry_call"), F.when(c("loose"), "missing_source_location")), F.coalesce("binding_gaps", none), F.coalesce("tail_gaps", none))
    gaps = F.array_sort(F.array_distinct(F.when(c("ended"), ends).otherwise(_gaps(c("wrong"), F.lit("missing_setter_call")))))
    paths = written(whole.select("trace", "state", "tail", "path", "chain", F.when(c("ended"), c("binding")).alias("binding"), gaps.alias("gaps")))
    unknown = requests.join(components.select("component").distinct(), "component", "left_anti").select("trace", F.lit("unknown_component").alias("issue"))
    return PropertyTraces(paths, walks.summed(paths, found.notes.union(cut.distinct()).union(unknown), requests))
