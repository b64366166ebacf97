"""Traces of measure and layout: from a pattern over its factory and algorithm to the operations and the property they read.

Every stage is one hop of joins for all requests at once. Where a stage has more candidates than the bound, the first ones by
identity go on and the cut is noted. Tables are those of factgraph.operators.framework; texts only corroborate what
references and proved relations say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators import framework
from factgraph.sources.workspace import written

#: What may stand between an operation's name and its body; a fixed value.
ARGUMENTS = "\\([^(){};]*\\)\\s*\\{"
#: Kinds of operations, the names that have them, and the relation that binds them to the algorithm; fixed values.
OPERATIONS = (("measure", ("Measure", "MeasureContent")), ("layout", ("Layout",)))


@dataclass(frozen=True)
class Idioms:
    """Patterns of sources: the factory's name and body (without its name), what stands in front of an allocated class, and an operation's preamble (groups: before the property, the property)."""

    factory_name: str
    factory: str
    allocation: str
    preamble: str


@dataclass(frozen=True)
class LayoutTraces:
    """stages: trace, stage (pattern, factory, algorithm, measure, layout, layout_property), node; calls: trace, caller, callee; summary: trace, status, exhaustive, gaps (comma-joined)."""

    stages: DataFrame
    calls: DataFrame
    summary: DataFrame


def limited(rows: DataFrame, label: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` nodes of each trace (trace, node), and the traces (trace, gap) where that cut some."""
    placed = rows.select("trace", "node").distinct().withColumn("n", F.row_number().over(Window.partitionBy("trace").orderBy("node"))).where(F.col("n") <= most + 1)
    return placed.where(F.col("n") <= most).drop("n"), placed.where(F.col("n") > most).select("trace", F.lit(f"{label}_candidate_limit").alias("gap"))


def layout_traces(requests: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, calls: DataFrame, files: DataFrame, mapping: DataFrame, relations: DataFrame, idioms: Idioms, max_candidates: int = 32, max_calls: int = 200) -> LayoutTraces:
    """Traces of all requests (trace, seed, component); relations: source, target, relation (create, measure, layout) that are proved.

    Gaps: missing_seed; ambiguous_<x>_role, ambiguous_<x>_role_conflict and unknown_or_cross_component_<x> for pattern, algorithm
    and property; ambiguous_factory_identity, missing_factory, missing_factory_definition, unsupported_factory_body;
    missing_algorithm_reference, ambiguous_algorithm_identity, missing_create_binding; for measure and layout ambiguous_<x>_identity,
    missing_<x>_binding, missing_<x>_implementation, unsupported_<x>_implementation; unsupported_property_preamble:<identity>,
    ambiguous_property_identity, missing_property_reference, missing_layout_property_dependency; <x>_candidate_limit and
    support_call_limit. A gap that begins with ambiguous makes a trace ambiguous, another one or a limit incomplete.
    """
    c = F.col
    requests = written(requests.select("trace", c("seed").alias("node"), "component"))
    own = framework.names(symbols).select(c("identity").alias("node"), "kind", "name", c("parent_identity").alias("owner"))
    methods = own.where("kind = 'method' and owner is not null")
    defined = symbol_ranges.where("role = 'definition'").select(c("symbol_identity").alias("node"), "file_path", "start_line", "start_column")
    roles = mapping.select(c("identity").alias("node"), "status", c("role").alias("own_role"), c("component").alias("own_component"))
    gaps, stages = [], []

    def note(rows: DataFrame, gap) -> None:
        gaps.append(rows.select("trace", (F.lit(gap) if isinstance(gap, str) else gap).alias("gap")).where("gap is not null").distinct())

    def of_role(rows: DataFrame, role: str, label: str) -> DataFrame:
        """The rows (trace, node, component) whose node has the role in the component; the others are noted."""
        seen = rows.join(roles, "node", "left")
        known = c("status") == "recognized"
        why = F.when(c("status") == "ambiguous", f"ambiguous_{label}_role").when(known & (c("own_role") != role), f"ambiguous_{label}_role_conflict").when(~F.coalesce(known & (c("own_component") == c("component")), F.lit(False)), f"unknown_or_cross_component_{label}")
        seen = written(seen.select(*rows.columns, why.alias("why")))
        note(seen, c("why"))
        return seen.where("why is null").drop("why")

    def cut(rows: DataFrame, label: str) -> DataFrame:
        kept, over = limited(rows, label, max_candidates)
        gaps.append(over)
        return kept

    def stage(rows: DataFrame, name: str) -> None:
        stages.append(rows.select("trace", F.lit(name).alias("stage"), "node"))

    components = requests.select("trace", "component")
    there = requests.join(own.select("node"), "node", "left_semi")
    note(requests.join(own.select("node"), "node", "left_anti"), "missing_seed")
    patterns = of_role(there, "pattern", "pattern")
    stage(patterns, "pattern")
    # the factory
    made = written(patterns.select("trace", c("node").alias("owner")).join(methods.where(c("name") == idioms.factory_name), "owner").select("trace", "node"))
    n = patterns.select("trace").join(made.groupBy("trace").agg(F.count("*").alias("n")), "trace", "left").fillna(0)
    note(n, F.when(c("n") > 1, "ambiguous_factory_identity").when(c("n") == 0, "missing_factory"))
    factories = cut(made, "factory")
    stage(factories, "factory")
    one = made.join(n.where("n = 1").select("trace"), "trace", "left_semi")
    note(one.join(defined.select("node"), "node", "left_anti"), "missing_factory_definition")
    seen = framework.windows(one.join(defined, "node"), files).withColumn("_p", F.lit(f"^(\\Q{idioms.factory_name}\\E{idioms.factory})")).withColumn("body", F.expr("regexp_extract(window, _p, 1)"))
    seen = written(seen.select("trace", "node", "file_path", "start_line", "start_column", F.when(c("body") != "", c("body")).alias("body")))
    note(seen.where("body is null"), "unsupported_factory_body")
    # what it allocates: the parts of its body behind each allocation
    parts = seen.where("body is not null").withColumn("parts", F.split("body", f"\\Q{idioms.allocation}\\E"))
    places = parts.select("trace", "file_path", "start_line", "start_column", "parts", F.explode(F.expr("sequence(1, greatest(1, size(parts) - 1))")).alias("at")).where("at < size(parts)")
    places = places.select("trace", "file_path", "start_line", "start_column", F.concat(F.array_join(F.slice("parts", F.lit(1), c("at")), idioms.allocation), F.lit(idioms.allocation)).alias("before"), F.regexp_extract(F.element_at("parts", c("at") + 1), "^(\\w+)", 1).alias("target"), F.concat_ws("\x1f", c("trace").cast("string"), "at").alias("place"))
    places = written(places)
    refs = written(framework.referred(places.drop("trace"), references, "place"))
    note(places.join(refs, "place", "left_anti"), "missing_algorithm_reference")
    targets = written(places.join(refs, "place").select("trace", F.explode("candidates").alias("node")).distinct())
    bodied = parts.select("trace").distinct()
    n = bodied.join(targets.groupBy("trace").agg(F.count("*").alias("n")), "trace", "left").fillna(0)
    note(n.where("n > 1"), "ambiguous_algorithm_identity")
    note(n.where("n <> 1"), "missing_create_binding")
    chosen = cut(targets, "algorithm").join(n.where("n = 1").select("trace"), "trace", "left_semi").join(components, "trace")
    algorithms = of_role(chosen, "layout_algorithm", "algorithm")
    proved = relations.select(c("source").alias("owner"), c("target").alias("node"), "relation").distinct()
    created = proved.where("relation = 'create'").select(c("owner").alias("factory"), "node")
    bound = algorithms.join(one.select("trace", c("node").alias("factory")), "trace")
    note(bound.join(created, ["factory", "node"], "left_anti"), "missing_create_binding")
    algorithms = written(bound.join(created, ["factory", "node"], "left_semi").select("trace", "node"))
    stage(algorithms, "algorithm")
    # its operations, each kind by itself
    operations = None
    for kind, names in OPERATIONS:
        members = written(algorithms.select("trace", c("node").alias("owner")).join(methods.where(c("name").isin(*names)), "owner").select("trace", "node", "owner", "name"))
        n = algorithms.select("trace").join(members.groupBy("trace").agg(F.count("*").alias("n")), "trace", "left").fillna(0)
        note(n, F.when(c("n") > 1, f"ambiguous_{kind}_identity").when(c("n") == 0, f"missing_{kind}_binding"))
        first = cut(members, kind).join(members, ["trace", "node"])
        first = first.join(proved.where(c("relation") == kind).select("owner", "node", F.lit(True).alias("bound")), ["owner", "node"], "left").join(defined, "node", "left")
        text = framework.windows(first, files).withColumn("_p", F.concat(F.lit("^\\Q"), "name", F.lit("\\E" + ARGUMENTS)))
        whole = F.coalesce(F.expr("window rlike _p"), F.lit(False))
        why = F.when(c("bound").isNull(), f"missing_{kind}_binding").when(c("file_path").isNull(), f"missing_{kind}_implementation").when(~whole, f"unsupported_{kind}_implementation")
        text = written(text.select("trace", "node", "name", "file_path", "start_line", "start_column", "window", why.alias("why")))
        note(text, c("why"))
        good = text.where("why is null").drop("why")
        stage(good, kind)
        operations = good if operations is None else operations.union(good)
    # the property that they read
    looked = framework.matched(operations, F.concat(F.lit("^(\\Q"), "name", F.lit("\\E" + ARGUMENTS + "\\s*"), F.lit(idioms.preamble)))
    looked = written(looked.withColumn("operation", F.concat_ws("\x1f", c("trace").cast("string"), "node")).drop("window"))
    note(looked.where("target is null"), F.concat(F.lit("unsupported_property_preamble:"), "node"))
    refs = framework.referred(looked.select("operation", "file_path", "start_line", "start_column", "before", "target"), references, "operation")
    read = written(looked.where("target is not null").select("trace", "operation").join(refs, "operation", "left"))
    note(read, F.when(c("refs") > 1, "ambiguous_property_identity").when(c("refs").isNull(), "missing_property_reference"))
    properties = written(of_role(read.where("refs = 1").select("trace", c("ref").alias("node")).join(components, "trace"), "layout_property", "property").select("trace", "node").distinct())
    n = algorithms.select("trace").join(properties.groupBy("trace").agg(F.count("*").alias("n")), "trace", "left").fillna(0)
    note(n, F.when(c("n") == 0, "missing_layout_property_dependency").when(c("n") > 1, "ambiguous_property_identity"))
    stage(cut(properties, "property"), "layout_property")
    # the calls of factories and operations, in order, as far as the bound allows
    callers = factories.select("trace", c("node").alias("caller")).union(operations.select("trace", c("node").alias("caller")))
    own_calls = callers.distinct().join(calls.select("caller", "callee").distinct(), "caller").withColumn("n", F.row_number().over(Window.partitionBy("trace").orderBy("caller", "callee"))).where(c("n") <= max_calls + 1)
    own_calls = written(own_calls)
    note(own_calls.where(c("n") > max_calls), "support_call_limit")
    noted = gaps[0]
    for g in gaps[1:]:
        noted = noted.union(g)
    staged = stages[0]
    for s in stages[1:]:
        staged = staged.union(s)
    said = noted.groupBy("trace").agg(F.array_sort(F.collect_set("gap")).alias("gaps"))
    rows = requests.select("trace").distinct().join(said, "trace", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))
    status = F.when(F.exists("gaps", lambda g: g.startswith("ambiguous_")), "ambiguous").when(F.size("gaps") > 0, "incomplete").otherwise("complete")
    summary = rows.select("trace", status.alias("status"), (~F.exists("gaps", lambda g: g.endswith("_limit"))).alias("exhaustive"), F.array_join("gaps", ",").alias("gaps"))
    return LayoutTraces(written(staged.distinct()), own_calls.where(c("n") <= max_calls).select("trace", "caller", "callee"), written(summary))
