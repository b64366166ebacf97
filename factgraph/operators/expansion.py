"""Bounded expansion of retrieval results through the graph, and the context candidates that come out of it.

An expansion runs jobs in order: a search from each seed, then the traces that were asked for. A job whose observation would
break a cap of the whole or of its seed is refused whole, and later jobs are judged without it. Observations are tables
keyed by job: nodes (job, namespace, key), edges (job and the edge's key) and paths (job, paths).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import graph
from factgraph.operators.ranks import ranked
from factgraph.sources.workspace import written

FAMILIES = ("creation", "property", "layout", "overlay")
#: Words of a task's actions that ask for a trace; fixed values.
ACTIONS = {"creation": ("create", "creation", "创建"), "layout": ("layout", "measure", "布局", "测量")}


@dataclass(frozen=True)
class Policy:
    """Budgets of an expansion; a seed's own bounds come first."""

    depth: int = 2
    nodes_per_seed: int = 100
    edges_per_seed: int = 200
    queries: int = 64
    nodes: int = 500
    edges: int = 1000
    queries_per_seed: int = 8
    paths_per_seed: int = 32
    paths: int = 128
    families: tuple[str, ...] = FAMILIES

    def __post_init__(self) -> None:
        for name in ("depth", "queries", "nodes", "edges", "edges_per_seed", "paths"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("nodes_per_seed", "queries_per_seed", "paths_per_seed"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if set(self.families) - set(FAMILIES):
            raise ValueError("unknown trace family")


@dataclass(frozen=True)
class Observations:
    """Results of traces: jobs (namespace, key, family, request, status, limitations), and nodes, edges and paths keyed by request."""

    jobs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame


@dataclass(frozen=True)
class Outcome:
    """Rows of all admitted jobs (job with nodes, edges), one report row for each job, and how much of the caps is used.

    Reports: job, namespace, key, family (null for a search), request, status (ok, truncated, unresolved, unsupported,
    partial, failure), diagnostics and limitations (sorted, comma-joined), n_nodes, n_edges, n_paths of the admitted
    observation, sources (path and sha256 of its files, where they are known).
    """

    nodes: DataFrame
    edges: DataFrame
    reports: DataFrame
    used: dict[str, int]


def seeds(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """What an expansion starts from: namespace, key, candidate_ids, query_ids, reasons, ambiguous, unresolved.

    facts: fact_type, namespace, key, candidate_id, query_id, ambiguous, unresolved (null keys, as of text hits, start
    nothing); queries: query_id, channel, namespace, key of selectors that name a node, which count even if no fact came of them.
    """
    own = facts.select("namespace", "key", "candidate_id", "query_id", F.concat(F.lit("fact:"), "fact_type").alias("reason"), "ambiguous", "unresolved")
    named = queries.select("namespace", "key", F.lit(None).cast("string").alias("candidate_id"), "query_id", F.lit("explicit_scoped_query_seed").alias("reason"), F.lit(False).alias("ambiguous"), F.lit(False).alias("unresolved"))
    sets = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (("candidate_id", "candidate_ids"), ("query_id", "query_ids"), ("reason", "reasons"))]
    return own.union(named).where("namespace is not null and key is not null").groupBy("namespace", "key").agg(*sets, F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("unresolved").alias("unresolved"))


def automatic_traces(tasks: DataFrame, found: DataFrame, mapping: DataFrame, symbols: DataFrame) -> DataFrame:
    """Traces that a task's actions ask for: task_id, family, namespace, key, component, reason.

    tasks: task_id and action, one row each; found: task_id, namespace, key of its seeds; mapping: identity, role, component of
    recognized symbols. A layout trace starts from a pattern of a component, a creation trace from a symbol whose parent is a
    bridge or model of one.
    """
    wanted = None
    for family, words in ACTIONS.items():
        rows = tasks.where(F.lower("action").isin(*words)).select("task_id", F.lit(family).alias("family")).distinct()
        wanted = rows if wanted is None else wanted.union(rows)
    roles = mapping.where("component is not null").select("identity", "role", "component")
    asked = found.join(wanted, "task_id")
    layout = asked.where("family = 'layout'").join(roles.where("role = 'pattern'"), F.col("key") == F.col("identity")).select("task_id", "family", "namespace", "key", "component", F.lit("action_and_pattern_role").alias("reason"))
    parents = symbols.where("parent_identity is not null").select(F.col("identity").alias("symbol"), "parent_identity")
    owned = asked.where("family = 'creation' and namespace = 'symbol'").join(parents, F.col("key") == F.col("symbol")).join(roles.where("role in ('bridge', 'model')"), F.col("parent_identity") == F.col("identity"))
    return layout.union(owned.select("task_id", "family", "namespace", "key", "component", F.lit("action_and_owner_role").alias("reason"))).distinct()


def admit(jobs: DataFrame, nodes: DataFrame, edges: DataFrame, paths: DataFrame, policy: Policy) -> tuple[DataFrame, dict[str, int]]:
    """Admit jobs (job, namespace, key) in order, each whole or not at all: job, exceeded (the caps it would break; empty if admitted).

    Caps hold for the distinct nodes and edges and the paths of all admitted jobs, and of those of one seed. A round refuses
    every job that no longer fits what is admitted, for what is admitted only grows; of the others the longest run from the
    front fits as a whole by running sums over what each job is the first to bring. Rounds end with the jobs; their number
    is that of the jobs that only what came before them in the same round keeps out.
    """
    kinds = {"node": (nodes, ["node_ns", "node_key"], policy.nodes, policy.nodes_per_seed), "edge": (edges, graph.KEY, policy.edges, policy.edges_per_seed)}
    seed = ["namespace", "key"]
    owned = {}
    for kind, (rows, own, _, _) in kinds.items():
        rows = rows.select("job", *(F.col(c).alias(n) for c, n in zip(seed, own, strict=True))) if kind == "node" else rows.select("job", *own)
        owned[kind] = written(rows.distinct().join(jobs, "job"))
    by_job = written(jobs.join(paths.groupBy("job").agg(F.sum("paths").alias("n_path")), "job", "left").fillna(0, ["n_path"]))
    pending, admitted = by_job, by_job.limit(0)
    used = {"node": 0, "edge": 0, "path": 0}
    while True:
        held = {kind: rows.join(admitted.select("job"), "job", "left_semi") for kind, rows in owned.items()}
        rows = pending.join(admitted.groupBy(*seed).agg(F.sum("n_path").alias("seed_path")), seed, "left")
        fresh = []
        for kind, (_, own, _, _) in kinds.items():
            mine = owned[kind].join(pending.select("job"), "job", "left_semi")
            held_by_seed = held[kind].select(*seed, *own).distinct()
            for of, group, known in (("", [], held[kind].select(*own).distinct()), ("seed_", seed, held_by_seed)):
                new = mine.join(known, [*group, *own], "left_anti")
                rows = rows.join(new.groupBy("job").agg(F.count("*").alias(f"{of}new_{kind}")), "job", "left")
                fresh.append((f"{of}brings_{kind}", [*group, *own], new))
            rows = rows.join(held_by_seed.groupBy(*seed).agg(F.count("*").alias(f"held_{kind}")), seed, "left")
        over = (F.col("n_path") + used["path"] > policy.paths) | (F.col("n_path") + F.col("seed_path") > policy.paths_per_seed)
        for kind, (_, _, cap, seed_cap) in kinds.items():
            over = over | (F.col(f"new_{kind}") + used[kind] > cap) | (F.col(f"seed_new_{kind}") + F.col(f"held_{kind}") > seed_cap)
        left = written(rows.fillna(0).where(~over))
        # what each remaining job is the first to bring, to the whole and to its seed
        live = left.select("job")
        for name, own, new in fresh:
            left = left.join(new.join(live, "job", "left_semi").groupBy(*own).agg(F.min("job").alias("job")).groupBy("job").agg(F.count("*").alias(name)), "job", "left")
        left = left.fillna(0)
        sums = {"node": F.col("brings_node"), "edge": F.col("brings_edge"), "path": F.col("n_path")}
        left = written(ranked(left, ["job"], "_at", sums=sums).drop("_at"))
        broken = (F.col("node") + F.col("brings_node") + used["node"] > policy.nodes) | (F.col("edge") + F.col("brings_edge") + used["edge"] > policy.edges) | (F.col("path") + F.col("n_path") + used["path"] > policy.paths)
        of_seed = {"s_node": F.col("seed_brings_node"), "s_edge": F.col("seed_brings_edge"), "s_path": F.col("n_path")}
        alone = ranked(left, [*seed, "job"], "_at", seed, of_seed)
        broken = broken | (F.col("s_node") + F.col("seed_brings_node") + F.col("held_node") > policy.nodes_per_seed) | (F.col("s_edge") + F.col("seed_brings_edge") + F.col("held_edge") > policy.edges_per_seed) | (F.col("s_path") + F.col("n_path") + F.col("seed_path") > policy.paths_per_seed)
        wall = alone.where(broken).agg(F.min("job")).first()[0]
        fits = F.lit(True) if wall is None else F.col("job") < wall
        more = left.where(fits).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("brings_node", "brings_edge", "n_path"))).first()
        used = {kind: n + m for (kind, n), m in zip(used.items(), more, strict=True)}
        admitted = admitted.union(left.where(fits).select(*admitted.columns))
        if wall is None:
            break
        pending = left.where(~fits).select(*by_job.columns)
    admitted = written(admitted)
    return _exceeded(by_job, owned, admitted, kinds, policy), {f"{kind}s": n for kind, n in used.items()}


def _exceeded(jobs: DataFrame, owned: dict[str, DataFrame], admitted: DataFrame, kinds: dict, policy: Policy) -> DataFrame:
    """job and exceeded: for each job that isn't admitted, the caps it would have broken after the admitted ones in front of it."""
    seed, none = ["namespace", "key"], F.array().cast("array<string>")
    if admitted.count() == jobs.count():
        return admitted.select("job", none.alias("exceeded"))
    rows = jobs.join(admitted.select("job", F.lit(True).alias("in")), "job", "left").withColumn("path_in", F.when(F.col("in"), F.col("n_path")))
    checks = [("path", "n_path", policy.paths, policy.paths_per_seed)]
    for kind, (_, own, cap, seed_cap) in kinds.items():
        for of, group in (("", []), ("seed_", seed)):
            # an item is held from the first admitted job on that has it
            first = owned[kind].join(admitted.select("job"), "job", "left_semi").groupBy(*group, *own).agg(F.min("job").alias("first"))
            fresh = owned[kind].join(first, [*group, *own], "left").where("first is null or first > job").groupBy("job").agg(F.count("*").alias(f"{of}new_{kind}"))
            rows = rows.join(fresh, "job", "left").join(first.groupBy(F.col("first").alias("job")).agg(F.count("*").alias(f"{of}{kind}_in")), "job", "left")
        checks.append((kind, f"new_{kind}", cap, seed_cap))
    whole = {kind: F.col("path_in" if kind == "path" else f"{kind}_in") for kind, *_ in checks}
    alone = {f"seed_{kind}": F.col("path_in" if kind == "path" else f"seed_{kind}_in") for kind, *_ in checks}
    rows = ranked(rows.fillna(0), ["job"], "_i", sums=whole).drop("_i")
    rows = ranked(rows, [*seed, "job"], "_i", seed, alone)
    over = []
    for kind, new, cap, seed_cap in checks:
        over += [F.when(F.col(kind) + F.col(new) > cap, f"global_{kind}_limit"), F.when(F.col(f"seed_{kind}") + F.col(new if kind == "path" else f"seed_{new}") > seed_cap, f"seed_{kind}_limit")]
    return rows.select("job", F.when(F.col("in"), none).otherwise(F.array_compact(F.array(*over))).alias("exceeded"))


def expand_seeds(nodes: DataFrame, edges: DataFrame, start: DataFrame, policy: Policy, direction: str = "outgoing", relations: list[str] | None = None, places: DataFrame | None = None, known: DataFrame | None = None, traces: Observations | None = None) -> Outcome:
    """Searches from all seeds (namespace, key), in order, and admits their observations and those of traces within the policy.

    places: namespace, key, path of the nodes' sources; known: path, sha256 of the snapshot's files. An observation with
    another file is unresolved and not admitted; a visited node without a source is noted. All searches are one job a level.
    """
    spark = nodes.sparkSession
    own = start.select("namespace", "key").distinct().select("namespace", "key", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("request"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("limitations"))
    jobs = own
    if traces is not None:
        jobs = own.unionByName(traces.jobs.join(start.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi").select(*own.columns))
    second = F.col("family").isNotNull()
    jobs = ranked(jobs.withColumn("_second", second.cast("int")), ["_second", "namespace", "key", "family", "request"], "job").drop("_second")
    enabled = ~second | F.col("family").isin(*policy.families)
    # a seed runs at most so many jobs, and all seeds together as well; a job that isn't enabled runs none
    if traces is None:
        jobs = jobs.select("*", enabled.alias("enabled"), F.lit(0).alias("of_seed"), F.col("job").alias("of_all"))
    else:
        jobs = ranked(jobs.withColumn("enabled", enabled), ["namespace", "key", "job"], "_i", ["namespace", "key"], {"of_seed": F.col("enabled").cast("int")}).drop("_i")
        jobs = ranked(jobs, ["job"], "_i", sums={"of_all": (F.col("enabled") & (F.col("of_seed") < policy.queries_per_seed)).cast("int")}).drop("_i")
    cut = F.when(F.col("of_all") >= policy.queries, "global_query_limit").when(F.col("of_seed") >= policy.queries_per_seed, "seed_query_limit")
    jobs = written(jobs.withColumn("cut", cut).withColumn("runs", F.col("cut").isNull() & F.col("enabled")))
    searched = graph.search(nodes, edges, jobs.where("runs and family is null").select(F.col("job").alias("seed"), "namespace", "key"), policy.depth, policy.nodes_per_seed, policy.edges_per_seed, direction, relations)
    seen_nodes = searched.visits.select(F.col("seed").alias("job"), "namespace", "key")
    seen_edges = searched.edges.select(F.col("seed").alias("job"), *graph.KEY)
    n_paths = spark.createDataFrame([], "job long, paths long")
    if traces is not None:
        asked = jobs.where("runs and family is not null").select("job", "request")
        seen_nodes = seen_nodes.union(traces.nodes.join(asked, "request").select("job", "namespace", "key"))
        seen_edges = seen_edges.union(traces.edges.join(asked, "request").select("job", *graph.KEY))
        n_paths = traces.paths.join(asked, "request").select("job", "paths")
    seen_nodes, seen_edges = written(seen_nodes.distinct()), written(seen_edges.distinct())
    rows = jobs.join(searched.stops.select(F.col("seed").alias("job"), "stopped_by", F.lit(True).alias("present")), "job", "left")
    outside = spark.createDataFrame([], "job long")
    sources = loose = None
    if places is not None:
        placed = seen_nodes.join(places.select("namespace", "key", "path").distinct(), ["namespace", "key"], "left")
        loose = placed.where("path is null").select("job").distinct().withColumn("loose", F.lit(True))
        rows = rows.join(loose, "job", "left")
        if known is not None:
            files = placed.where("path is not null").select("job", "path").distinct().join(known.select("path", "sha256"), "path", "left")
            outside = written(files.where("sha256 is null").select("job").distinct())
            sources = files.where("sha256 is not null").groupBy("job").agg(F.array_sort(F.collect_set(F.struct("path", "sha256"))).alias("sources"))
    inside = lambda df: df.join(outside, "job", "left_anti")
    ready = inside(rows.where("runs")).select("job", "namespace", "key")
    verdicts, used = admit(ready, inside(seen_nodes), inside(seen_edges), inside(n_paths), policy)
    rows = rows.join(verdicts, "job", "left").join(outside.withColumn("outside", F.lit(True)), "job", "left")
    for name in ("sources",) if sources is not None else ():
        rows = rows.join(sources, "job", "left")
    taken = F.coalesce(F.size("exceeded") == 0, F.lit(False))
    counts = [df.groupBy("job").agg(n.alias(c)) for df, n, c in ((seen_nodes, F.count("*"), "n_nodes"), (seen_edges, F.count("*"), "n_edges"), (n_paths, F.sum("paths"), "n_paths"))]
    for part in counts:
        rows = rows.join(part, "job", "left")
    is_search, absent = F.col("family").isNull(), F.col("family").isNull() & F.col("present").isNull()
    refused = F.coalesce(F.size("exceeded") > 0, F.lit(False))
    status = (
        F.when(F.col("cut").isNotNull() | refused, "truncated").when(~F.col("enabled"), "unsupported").when(absent | F.col("outside"), "unresolved").when(is_search & F.col("stopped_by").isNotNull(), "truncated")
        .when(~is_search & (F.col("status") == "ok"), "partial").when(~is_search & (F.col("status") == "complete"), "ok").otherwise(F.col("status"))
    )
    noted = F.array_compact(F.concat(F.array(
        F.col("cut"), F.when(F.col("cut").isNull() & ~F.col("enabled"), "trace_family_disabled"), F.when(F.col("runs") & is_search, f"depth_scope:{policy.depth}"), F.when(F.col("runs") & absent, "seed_absent_from_graph"),
        F.when(F.col("outside"), "observation_source_outside_fingerprint"), F.when(taken & is_search & (F.col("loose") if loose is not None else F.lit(False)), "unresolved_node_source"),
        *(F.when(F.col("runs") & is_search, f"unsupported_relation:{r}") for r in graph.UNAVAILABLE if relations and r in relations),
    ), F.coalesce("exceeded", F.array().cast("array<string>"))))
    limits = F.array_compact(F.concat("limitations", F.array("stopped_by")))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    counted = lambda c: F.when(taken, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long").alias(c)
    no_sources = F.array().cast("array<struct<path:string,sha256:string>>")
    own_sources = F.when(taken, F.coalesce("sources", no_sources)).otherwise(no_sources) if sources is not None else no_sources
    reports = rows.select("job", "namespace", "key", "family", "request", status.alias("status"), joined(noted).alias("diagnostics"), joined(limits).alias("limitations"), counted("n_nodes"), counted("n_edges"), counted("n_paths"), own_sources.alias("sources"))
    admitted = verdicts.where(F.size("exceeded") == 0).select("job")
    used["queries"] = jobs.where("runs").count()
    return Outcome(seen_nodes.join(admitted, "job", "left_semi"), seen_edges.join(admitted, "job", "left_semi"), written(reports), used)


def expand_change(new: tuple | None, old: tuple | None, policy: Policy, direction: str = "both", relations: list[str] | None = None, **tables) -> tuple[Outcome | None, Outcome | None]:
    """Both sides of a change, each nodes, edges and seeds, or None: the new one first, the old one within what it left of the caps."""
    first = None if new is None else expand_seeds(*new, policy, direction, relations, **tables.get("new", {}))
    if first is not None:
        policy = replace(policy, **{c: getattr(policy, c) - first.used[c] for c in ("nodes", "edges", "paths", "queries")})
    return first, None if old is None else expand_seeds(*old, policy, direction, relations, **tables.get("old", {}))


@dataclass(frozen=True)
class Expansion:
    """nodes and edges of all admitted seeds, and a report row for each seed that was asked: status admitted, stopped_by, counts of what it added."""

    nodes: DataFrame
    edges: DataFrame
    reports: list[tuple[str, str, str, str | None, int, int]]


def expand(nodes: DataFrame, edges: DataFrame, start: DataFrame, policy: Policy, direction: str = "outgoing") -> Expansion:
    """``expand_seeds`` without sources and traces, with the reports of the seeds up to the first one beyond the query limit, at most ``policy.queries`` + 1."""
    found = expand_seeds(nodes, edges, start, policy, direction)
    brought = []
    for rows, own, name in ((found.nodes, ["namespace", "key"], "more_nodes"), (found.edges, graph.KEY, "more_edges")):
        brought.append(rows.groupBy(*own).agg(F.min("job").alias("job")).groupBy("job").agg(F.count("*").alias(name)))
    rows = found.reports.join(brought[0], "job", "left").join(brought[1], "job", "left").fillna(0, ["more_nodes", "more_edges"])
    reports = []
    for r in rows.where(F.col("job") <= policy.queries).orderBy("job").collect():
        caps = [c for c in ("query", "node", "edge") if f"global_{c}_limit" in r.diagnostics.split(",")]
        if caps:
            reports.append((r.namespace, r.key, "truncated", "query_limit" if caps[0] == "query" else f"{caps[0]}_cap", 0, 0))
        else:
            reports.append((r.namespace, r.key, "admitted", r.limitations or None, r.more_nodes, r.more_edges))
    return Expansion(found.nodes.select("namespace", "key").distinct(), found.edges.select(*graph.KEY).distinct(), reports)


def context(expansion_nodes: DataFrame, expansion_edges: DataFrame, candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """Context candidates of two kinds, node and relation: kind, context_key, paths they depend on, directly retrieved or not.

    A node inherits the ranges of its facts (symbol_identity); a relation depends on what its ends depend on.
    """
    places = ranges.groupBy(F.col("symbol_identity").alias("key")).agg(F.array_sort(F.collect_set("file_path")).alias("paths"))
    direct = candidates.select(F.col("fact_key").alias("key"), F.lit(True).alias("retrieved")).distinct()
    nodes = expansion_nodes.join(places, "key", "left").join(direct, "key", "left").select("namespace", "key", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), F.coalesce("retrieved", F.lit(False)).alias("retrieved"))
    ends = [nodes.select(F.col("namespace").alias(f"{s}_ns"), F.col("key").alias(f"{s}_key"), F.col("paths").alias(f"{s}_paths")) for s in ("src", "dst")]
    relations = expansion_edges.join(ends[0], ["src_ns", "src_key"]).join(ends[1], ["dst_ns", "dst_key"])
    own = nodes.select(F.lit("node").alias("kind"), F.col("key").alias("context_key"), "paths", "retrieved")
    return own.union(relations.select(F.lit("relation"), F.concat_ws(">", "src_key", "dst_key", "relation"), F.array_sort(F.array_union("src_paths", "dst_paths")), F.lit(False)))
