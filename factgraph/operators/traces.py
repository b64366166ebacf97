"""Proof-bound relations and staged traces over a fact graph; the catalogs (roles, templates, stages) are tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import graph
from factgraph.operators.snippets import line_offsets

WINDOW_CHARS = 2048


def verified_edges(supplied: DataFrame, projected: DataFrame) -> DataFrame:
    """Supplied edges that the index proves: their evidence holds all of the regenerated edge's evidence.

    Both are evidence rows; edges of the index that the supplied graph lacks or robs of evidence are ``broken``.
    """
    rest = [c for c in projected.columns if c not in graph.KEY]
    flat = lambda rows: rows.select(*graph.KEY, F.to_json(F.struct(*rest)).alias("proof")).distinct()
    both = flat(projected).withColumn("own", F.lit(1)).join(flat(supplied).withColumn("given", F.lit(1)), [*graph.KEY, "proof"], "left")
    return both.groupBy(*graph.KEY).agg(F.count("own").alias("proofs"), F.when(F.count("given") == F.count("own"), "verified").otherwise("broken").alias("state"))


def owner_roles(symbols: DataFrame, mapping: DataFrame) -> DataFrame:
    """identity, owner, role and component of the recognized class that a symbol belongs to; a symbol without one has nulls."""
    roles = mapping.where("status = 'recognized'").select(F.col("identity").alias("owner"), F.substring_index("candidates", "/", 1).alias("role"), F.substring_index("candidates", "/", -1).alias("component"))
    return symbols.select("identity", F.col("parent_identity").alias("owner")).join(roles, "owner", "left").select("identity", "owner", "role", "component")


def template_relations(symbols: DataFrame, symbol_ranges: DataFrame, files: DataFrame, mapping: DataFrame, templates: DataFrame) -> DataFrame:
    """Relations from a class of a role to its own method, proved by the source of both ranges, or the diagnostic why not.

    templates: role, method, relation, declaration_pattern, body_pattern. Rows: class_id, method_id, relation, diagnostic
    (null for a proved relation, else missing_definition, unsupported_declaration_template or unsupported_body_template).
    Windows of the source are cut once for each range, from the line it begins on.
    """
    owned = owner_roles(symbols, mapping).where("role is not null").join(symbols.select("identity", "display_name"), "identity")
    wanted = owned.join(F.broadcast(templates), (owned["role"] == templates["role"]) & (owned["display_name"] == templates["method"])).select("identity", "owner", "relation", "declaration_pattern", "body_pattern")
    places = symbol_ranges.join(wanted.select(F.col("identity").alias("symbol_identity")).distinct(), "symbol_identity", "left_semi").select("symbol_identity", "role", F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    source = files.join(places.select("path").distinct(), "path", "left_semi")
    windows = places.join(line_offsets(source), ["path", "line"]).join(source.select("path", "content"), "path").select("symbol_identity", "role", F.expr(f"substring(content, cast(offset + column as int), {WINDOW_CHARS})").alias("window"))
    pivot = windows.groupBy("symbol_identity").agg(F.max(F.when(F.col("role") == "declaration", F.col("window"))).alias("declared"), F.max(F.when(F.col("role") == "definition", F.col("window"))).alias("defined"))
    rows = wanted.join(pivot, wanted["identity"] == pivot["symbol_identity"], "left")
    match = lambda text, pattern: F.coalesce(F.expr(f"{text} rlike {pattern}"), F.lit(False))
    diagnostic = F.when(~match("declared", "declaration_pattern"), "unsupported_declaration_template").when(F.col("defined").isNull(), "missing_definition").when(~match("defined", "body_pattern"), "unsupported_body_template")
    return rows.select(F.col("owner").alias("class_id"), F.col("identity").alias("method_id"), "relation", diagnostic.alias("diagnostic"))


@dataclass(frozen=True)
class Trace:
    """Paths with their gaps, the overall status, and why the search wasn't exhaustive."""

    paths: DataFrame
    status: str
    exhaustive: bool
    issues: tuple[str, ...]


def staged_trace(edges: DataFrame, stages: DataFrame, seed: tuple[str, str], order: list[str], max_depth: int = 8, max_paths: int = 32, max_states: int = 1000, relations: list[str] | None = None) -> Trace:
    """Simple paths from a seed that pass the stages in order, each with ``gaps``.

    stages: namespace, key, stage. Only nodes from which a last-stage node can be reached are walked. A path's gaps are
    ``missing_<stage>_stage`` for stages it lacks, ``stage_order`` if it has them in another order, ``ambiguous_role`` for
    a node of several stages. One complete path found exhaustively is complete; several paths, or an ambiguous one, are
    ambiguous; else it is incomplete. Without a way to the last stage there is no path and ``missing_entry_stage``.
    """
    targets = stages.where(F.col("stage") == order[-1]).select("namespace", "key")
    useful = graph.reaching(edges, targets, relations, max_depth)
    if useful.where((F.col("namespace") == seed[0]) & (F.col("key") == seed[1])).isEmpty():
        none = edges.sparkSession.createDataFrame([], "state int, path array<string>, gaps array<string>")
        return Trace(none, "incomplete", False, ("missing_entry_stage",))
    kept = edges.join(useful.select(F.col("namespace").alias("dst_ns"), F.col("key").alias("dst_key")), ["dst_ns", "dst_key"], "left_semi").select(*graph.KEY)
    ended = kept.join(targets.select(F.col("namespace").alias("src_ns"), F.col("key").alias("src_key")), ["src_ns", "src_key"], "left_anti").select(*graph.KEY)
    found = graph.simple_paths(ended, *seed, max_depth, max_paths, max_states, relations)
    own = stages.groupBy("namespace", "key").agg(F.min("stage").alias("stage"), (F.count_distinct("stage") > 1).alias("ambiguous"))
    steps = found.paths.select("state", "length", F.posexplode("path").alias("at", "node")).select("state", "length", "at", F.col("node.namespace").alias("namespace"), F.col("node.key").alias("key")).join(F.broadcast(own), ["namespace", "key"], "left")
    known = F.array(*map(F.lit, order))
    seen = steps.groupBy("state", "length").agg(F.array_sort(F.collect_list(F.struct("at", "key", "stage"))).alias("steps"), F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))
    passed = F.array_distinct(F.filter(F.transform("steps", lambda s: s["stage"]), lambda s: s.isNotNull()))
    missing = F.transform(F.array_except(known, passed), lambda s: F.concat(F.lit("missing_"), s, F.lit("_stage")))
    in_order = F.filter(known, lambda s: F.array_contains(passed, s)) == F.filter(passed, lambda s: F.array_contains(known, s))
    gaps = F.concat(missing, F.when(in_order, F.array().cast("array<string>")).otherwise(F.array(F.lit("stage_order"))), F.when(F.col("ambiguous"), F.array(F.lit("ambiguous_role"))).otherwise(F.array().cast("array<string>")))
    paths = seen.select("state", F.transform("steps", lambda s: s["key"]).alias("path"), gaps.alias("gaps")).orderBy("state")
    facts = paths.agg(F.count("*"), F.count_if(F.size("gaps") == 0), F.bool_or(F.array_contains("gaps", "ambiguous_role"))).first()
    status = "ambiguous" if facts[0] > 1 or facts[2] else "complete" if found.exhaustive and facts[1] == 1 else "incomplete"
    return Trace(paths, status, found.exhaustive, found.issues)
