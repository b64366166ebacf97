"""Typed evidence graphs: building, lookups, budgeted breadth-first search, closures and simple paths.

Nodes: namespace, key, kind, display_name. Edge evidence, one row each: src_ns, src_key, dst_ns, dst_key, relation,
provenance and further columns. Results don't depend on the order of input rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.index import FactError
from factgraph.operators.ranks import ranked
from factgraph.sources.workspace import written

KEY = ["src_ns", "src_key", "dst_ns", "dst_key", "relation"]
#: Relations that facts never prove; a graph names them as unavailable.
UNAVAILABLE = ("inherit", "override")


@dataclass(frozen=True)
class Traversal:
    """visits(rank, namespace, key, depth), edges, and what stopped the search: None, edge_limit or node_limit."""

    visits: DataFrame
    edges: DataFrame
    stopped_by: str | None


def merge_evidence(evidence: DataFrame) -> DataFrame:
    """One row for each edge with the union of its evidence, sorted; merging again changes nothing."""
    rest = [c for c in evidence.columns if c not in KEY]
    return evidence.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(*rest))).alias("evidence"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node."""
    out = None
    for side in ("src", "dst"):
        known = nodes.select(F.col("namespace").alias(f"{side}_ns"), F.col("key").alias(f"{side}_key")).distinct()
        found = edges.join(known, [f"{side}_ns", f"{side}_key"], "left_anti").select(*KEY, F.lit(side).alias("missing"))
        out = found if out is None else out.union(found)
    return out


def checked(nodes: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and merged edges; a node of two meanings or an edge without its node fails."""
    nodes = nodes.distinct()
    if not nodes.groupBy("namespace", "key").count().where("count > 1").isEmpty():
        raise FactError("a node has two meanings")
    if not dangling_edges(nodes, evidence.select(*KEY).distinct()).isEmpty():
        raise FactError("an edge has no node")
    return nodes, merge_evidence(evidence)


def related(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    """None keeps all relations, an empty list none."""
    return edges if relations is None else edges.where(F.col("relation").isin(*relations) if relations else F.lit(False))


def outgoing(edges: DataFrame, namespace: str, key: str, relations: list[str] | None = None) -> DataFrame:
    return related(edges, relations).where((F.col("src_ns") == namespace) & (F.col("src_key") == key)).orderBy(*KEY)


def incoming(edges: DataFrame, namespace: str, key: str, relations: list[str] | None = None) -> DataFrame:
    return related(edges, relations).where((F.col("dst_ns") == namespace) & (F.col("dst_key") == key)).orderBy(*KEY)


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """Edges with where they lead from and to; a self-loop once for both directions."""
    out = edges.select(*KEY, F.col("src_ns").alias("from_ns"), F.col("src_key").alias("from_key"), F.col("dst_ns").alias("to_ns"), F.col("dst_key").alias("to_key"))
    into = edges.select(*KEY, F.col("dst_ns").alias("from_ns"), F.col("dst_key").alias("from_key"), F.col("src_ns").alias("to_ns"), F.col("src_key").alias("to_key"))
    if direction == "outgoing":
        return out
    return into if direction == "incoming" else out.union(into).dropDuplicates([*KEY, "from_ns", "from_key"])


def neighbors(nodes: DataFrame, edges: DataFrame, namespace: str, key: str, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """Distinct nodes one step away, by namespace and key; a self-loop gives the node itself."""
    reached = _steps(related(edges, relations), direction).where((F.col("from_ns") == namespace) & (F.col("from_key") == key)).select(F.col("to_ns").alias("namespace"), F.col("to_key").alias("key")).distinct()
    return nodes.join(reached, ["namespace", "key"], "left_semi").orderBy("namespace", "key")


@dataclass(frozen=True)
class Search:
    """Of each seed: visits(seed, rank, namespace, key, depth), edges(seed and KEY), and stops(seed, stopped_by, n_nodes, n_edges).

    stopped_by is null, edge_limit or node_limit; a seed that is no node has neither visits nor a row in stops.
    """

    visits: DataFrame
    edges: DataFrame
    stops: DataFrame


def search(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = 100, max_edges: int | None = 1000, direction: str = "outgoing", relations: list[str] | None = None) -> Search:
    """Breadth-first searches from all seeds (seed, namespace, key) at once, level by level, each as if it were the only one.

    A search admits edges one by one, in the order of the parent's rank and the edge's key. An edge beyond ``max_edges``
    stops it, or else one that leads to a new node beyond ``max_nodes``; both only when something is turned away, and None
    is no bound. Reaching ``max_depth`` is no truncation. The number of jobs grows with the depth alone; places within a search are ranks over
    sorted partitions, so neither many seeds nor the edges of one node go to one task.
    """
    room = max_nodes is None or max_nodes > 0
    steps = written(_steps(related(edges, relations).select(*KEY).distinct(), direction))
    at = lambda rows: rows.select("seed", F.col("namespace").alias("to_ns"), F.col("key").alias("to_key"))
    start = seeds.select("seed", "namespace", "key").join(nodes.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi")
    visits = written(start.select("seed", F.lit(0).cast("long").alias("rank"), "namespace", "key", F.lit(0).alias("depth")).where(F.lit(room)))
    stops = start.select("seed", F.lit(None if room else "node_limit").cast("string").alias("stopped_by"), F.lit(int(room)).cast("long").alias("n_nodes"), F.lit(0).cast("long").alias("n_edges"))
    stops = written(stops)
    admitted = edges.select(F.lit(None).cast(visits.schema["seed"].dataType).alias("seed"), *KEY).limit(0)
    for depth in range(max_depth if room else 0):
        frontier = visits.where(F.col("depth") == depth).join(stops.where("stopped_by is null").select("seed"), "seed", "left_semi")
        found = steps.join(frontier.select("seed", "rank", F.col("namespace").alias("from_ns"), F.col("key").alias("from_key")), ["from_ns", "from_key"])
        if direction == "both":
            found = found.join(admitted, ["seed", *KEY], "left_anti")
        once = found.groupBy("seed", *KEY).agg(F.min(F.struct("rank", "to_ns", "to_key")).alias("f")).select("seed", "f.rank", *KEY, "f.to_ns", "f.to_key")
        unseen = once.join(at(visits), ["seed", "to_ns", "to_key"], "left_anti").groupBy("seed", "to_ns", "to_key").agg(F.min(F.struct("rank", *KEY)).alias("first"))
        marked = once.join(unseen, ["seed", "to_ns", "to_key"], "left").withColumn("is_new", F.coalesce(F.col("first") == F.struct("rank", *KEY), F.lit(False))).drop("first")
        rows = ranked(marked, ["seed", "rank", *KEY], "i", ["seed"], {"n": F.col("is_new").cast("int")}).join(stops.drop("stopped_by"), "seed").withColumn("n", F.col("n") + F.col("n_nodes"))
        full = F.lit(False) if max_edges is None else F.col("i") + F.col("n_edges") >= max_edges
        stop = F.when(full, "edge_limit").when(F.lit(False) if max_nodes is None else F.col("is_new") & (F.col("n") >= max_nodes), "node_limit")
        walls = rows.withColumn("by", stop).where("by is not null").groupBy("seed").agg(F.min(F.struct("i", "by")).alias("wall"))
        taken = written(rows.join(walls, "seed", "left").where("wall is null or i < wall.i").select("seed", *KEY, "is_new", "n", "to_ns", "to_key"))
        grown = taken.where("is_new").select("seed", F.col("n").alias("rank"), F.col("to_ns").alias("namespace"), F.col("to_key").alias("key"), F.lit(depth + 1).alias("depth"))
        admitted, visits = admitted.union(taken.select("seed", *KEY)), visits.union(grown)
        if depth + 1 < max_depth and grown.isEmpty():
            max_depth = depth + 1
        more = taken.groupBy("seed").agg(F.count("*").alias("more_edges"), F.count_if("is_new").alias("more_nodes"))
        plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        stops = written(stops.join(more, "seed", "left").join(walls, "seed", "left").select("seed", F.coalesce("stopped_by", F.col("wall")["by"]).alias("stopped_by"), plus("n_nodes", "more_nodes"), plus("n_edges", "more_edges")))
        if depth + 1 == max_depth:
            break
    return Search(visits, admitted, stops)


def traverse(nodes: DataFrame, edges: DataFrame, namespace: str, key: str, max_depth: int, max_nodes: int | None = 100, max_edges: int | None = 1000, direction: str = "outgoing", relations: list[str] | None = None) -> Traversal:
    """The breadth-first search from one node; see ``search``."""
    seed = nodes.sparkSession.createDataFrame([(0, namespace, key)], "seed long, namespace string, key string")
    found = search(nodes, edges, seed, max_depth, max_nodes, max_edges, direction, relations)
    stop = found.stops.first()
    return Traversal(found.visits.drop("seed").orderBy("rank"), found.edges.drop("seed").orderBy(*KEY), stop and stop.stopped_by)


def reaching(edges: DataFrame, targets: DataFrame, relations: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes (namespace, key) from which a target can be reached, the targets among them, by rounds of semi-joins."""
    steps = related(edges, relations).select(*KEY[:4]).distinct()
    found = written(targets.select("namespace", "key").distinct())
    fresh, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        back = steps.join(fresh.select(F.col("namespace").alias("dst_ns"), F.col("key").alias("dst_key")), ["dst_ns", "dst_key"], "left_semi").select(F.col("src_ns").alias("namespace"), F.col("src_key").alias("key")).distinct()
        fresh = written(back.join(found, ["namespace", "key"], "left_anti"))
        if fresh.isEmpty():
            break
        found = written(found.union(fresh))
    return found


@dataclass(frozen=True)
class Paths:
    """Emitted paths in depth-first preorder, and whether nothing was left out; issues say why not."""

    paths: DataFrame
    exhaustive: bool
    issues: tuple[str, ...]


def simple_paths(edges: DataFrame, namespace: str, key: str, max_depth: int = 8, max_paths: int = 32, max_states: int = 1000, relations: list[str] | None = None) -> Paths:
    """Maximal simple paths from a node: rows path (nodes), edges (keys), length, state (1-based).

    A step that would close a cycle is left out and noted. A path ends where no other step goes on, or at ``max_depth``.
    Depth-first preorder is the order of the arrays of edge keys, so states are numbered by their ranks in it
    instead of a stack; each level keeps the ``max_states`` smallest states, which no later one can come before.
    """
    node = lambda ns, k: F.struct(F.col(ns).alias("namespace"), F.col(k).alias("key"))
    steps = related(edges, relations).select(*KEY).distinct()
    steps = written(steps.select(node("src_ns", "src_key").alias("at"), node("dst_ns", "dst_key").alias("to"), F.struct(*KEY).alias("edge")))
    spark = edges.sparkSession
    level = spark.range(1).select(F.array(F.struct(F.lit(namespace).alias("namespace"), F.lit(key).alias("key"))).alias("path"), F.array().cast(f"array<{steps.schema['edge'].dataType.simpleString()}>").alias("keys"))
    states = None
    issues: set[str] = set()
    for depth in range(max_depth + 1):
        level = level.withColumn("at", F.element_at("path", -1))
        onward = level.join(steps, "at").withColumn("cycle", F.expr("array_contains(path, to)"))
        onward = written(onward)
        children = onward.where("not cycle")
        flags = onward.groupBy("keys").agg(F.bool_or("cycle").alias("cycle"), F.bool_or(~F.col("cycle")).alias("onward"))
        own = level.join(flags, "keys", "left").select("path", "keys", F.coalesce("cycle", F.lit(False)).alias("cycle"), F.coalesce("onward", F.lit(False)).alias("onward"), F.lit(depth).alias("depth"))
        states = written(own if states is None else states.union(own))
        if depth == max_depth or children.isEmpty():
            break
        level = written(children.select(F.concat("path", F.array("to")).alias("path"), F.concat("keys", F.array("edge")).alias("keys")).orderBy("keys").limit(max_states))
    leaf = ~F.col("onward") | (F.col("depth") == max_depth)
    rows = written(ranked(states.withColumn("leaf", leaf), ["keys"], "state", sums={"before": F.col("leaf").cast("int")}).withColumn("state", F.col("state") + 1))
    seen = rows.where((F.col("state") <= max_states) & (F.col("before") < max_paths))
    if seen.count() < rows.count():
        issues.add("state_or_path_limit")
    noted = seen.agg(F.bool_or("cycle"), F.bool_or(F.col("onward") & (F.col("depth") == max_depth))).first()
    issues |= {name for name, hit in zip(("cycle_cut", "depth_limit"), noted, strict=True) if hit}
    return Paths(seen.where("leaf").select("path", F.col("keys").alias("edges"), F.size("keys").alias("length"), "state").orderBy("state"), not issues, tuple(sorted(issues)))


def project(symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, relations: DataFrame, entities: DataFrame, fixture_cases: DataFrame, test_references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of an index: nodes and edge evidence. Dangling call ends become plain symbol nodes; nothing is inferred for inherit and override."""
    kinds = F.create_map(*(F.lit(x) for pair in (("function", "function"), ("method", "method"), ("class", "class"), ("struct", "class")) for x in pair))
    kind_of = lambda c: F.coalesce(F.try_element_at(kinds, F.col(c)), F.lit("symbol"))
    lit = F.lit

    def edge(rows: DataFrame, src_ns: str, src: str, dst: str, relation, provenance: str) -> DataFrame:
        place = [F.col(c).cast("string" if c == "file_path" else "long").alias(c) if c in rows.columns else F.lit(None).cast("string" if c == "file_path" else "long").alias(c) for c in ("file_path", "start_line", "start_column", "end_line", "end_column")]
        return rows.select(lit(src_ns).alias("src_ns"), F.col(src).alias("src_key"), lit("symbol").alias("dst_ns"), F.col(dst).alias("dst_key"), (lit(relation) if isinstance(relation, str) else relation).alias("relation"), lit(provenance).alias("provenance"), *place)

    calls = {kind: relations.where(F.col("relation_kind") == kind) for kind in ("caller", "callee")}
    test_references = written(test_references)
    # parts differ in their provenance, so each is made distinct by itself: what is distinct already isn't dealt again, and ends are told from their columns alone
    parts = [
        (edge(symbol_ranges, "file", "file_path", "symbol_identity", F.when(F.col("role") == "definition", "define").otherwise("declare"), "index.range"), "file"),
        (edge(references, "file", "file_path", "symbol_identity", "reference", "index.reference"), "file"),
        (edge(test_references, "symbol", "case_identity", "symbol_identity", "test", "index.test_reference"), "symbol"),
        (edge(fixture_cases.join(entities, fixture_cases["case_identity"] == entities["identity"]), "symbol", "fixture_identity", "case_identity", "test", "index.fixture"), "symbol"),
        (edge(calls["caller"], "symbol", "target_identity", "source_identity", "call", "index.callers"), "symbol"),
        (edge(calls["callee"], "symbol", "source_identity", "target_identity", "call", "index.callees"), "symbol"),
    ]
    evidence, found = None, {"symbol": None, "file": None}
    for part, source in parts:
        evidence = part.distinct() if evidence is None else evidence.unionByName(part.distinct())
        for namespace, end in ((source, "src_key"), ("symbol", "dst_key")):
            keys = part.select(F.col(end).alias("identity")).distinct()
            found[namespace] = keys if found[namespace] is None else found[namespace].union(keys)
    own = symbols.select("identity", kind_of("kind").alias("kind"), "display_name")
    tests = entities.select("identity", F.concat(lit("test_"), "kind").alias("kind"), "display_name")
    named = own.join(tests.select("identity"), "identity", "left_anti").union(tests)
    loose = found["symbol"].distinct().join(named.select("identity"), "identity", "left_anti").select("identity", lit("symbol").alias("kind"), F.col("identity").alias("display_name"))
    files = found["file"].distinct().select("identity", lit("file").alias("kind"), F.col("identity").alias("display_name"))
    nodes = named.union(loose).select(lit("symbol").alias("namespace"), F.col("identity").alias("key"), "kind", "display_name").union(files.select(lit("file").alias("namespace"), F.col("identity").alias("key"), "kind", "display_name"))
    return nodes.distinct(), evidence
