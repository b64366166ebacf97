"""Candidate retrieval: each query goes to its channel, all channels' facts are one table, budgets and gaps are reported.

Facts are rows query_id, channel, fact_type, fact_key, paths (array), ambiguous, unresolved. Every channel is a join of
the queries with the fact tables, so a request of many queries reads each table once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators import graph, index, retrieval
from factgraph.operators.retrieval import Bounds
from factgraph.sources.workspace import written

#: Channels whose queries name a symbol.
SYMBOL_CHANNELS = ("symbol", "declaration", "definition", "reference", "callers", "callees", "tests_for_symbol")


@dataclass(frozen=True)
class Facts:
    """The tables that channels read; ``mapping`` is the roles' table (identity, status, candidates)."""

    symbols: DataFrame
    symbol_ranges: DataFrame
    references: DataFrame
    relations: DataFrame
    entities: DataFrame
    fixture_cases: DataFrame
    test_references: DataFrame
    nodes: DataFrame
    edges: DataFrame
    mapping: DataFrame


def change_queries(seeds: DataFrame, side: str, channels: tuple[str, ...] = SYMBOL_CHANNELS) -> DataFrame:
    """Queries of a change's seeds (seed_kind symbol or graph, key) on one side: each seed for each channel that takes its kind."""
    own = [("symbol", c) for c in channels if c in SYMBOL_CHANNELS] + [("graph", c) for c in channels if c.startswith("graph_")]
    kinds = seeds.sparkSession.createDataFrame(own or [("", "")], "seed_kind string, channel string")
    rows = seeds.select("seed_kind", F.col("key").alias("selector")).distinct().join(F.broadcast(kinds), "seed_kind")
    return rows.select(retrieval.stable_id(F.lit(side), "channel", "selector").alias("query_id"), F.lit(side).alias("side"), "channel", "selector", F.lit(True).alias("by_identity"))


def named(queries: DataFrame, symbols: DataFrame, bounds: Bounds) -> DataFrame:
    """query_id, channel, identity, ambiguous, names_cut of the symbols that queries of symbol channels name or seed."""
    own = queries.where(F.col("channel").isin(*SYMBOL_CHANNELS))
    pick = lambda rows, column: rows.join(symbols.select("identity", F.col(column).alias("selector")), "selector").select("query_id", "channel", "identity").distinct()
    by_name = pick(own.where("not by_identity and not qualified"), "display_name").union(pick(own.where("not by_identity and qualified"), "qualified_name"))
    some = retrieval.first_n(by_name, ["query_id"], ["identity"], bounds.names).select("query_id", "channel", "identity", (F.col("total") > 1).alias("ambiguous"), F.col("truncated").alias("names_cut"))
    seeded = own.where("by_identity").join(symbols.select("identity", F.col("identity").alias("selector")), "selector").select("query_id", "channel", "identity", F.lit(False).alias("ambiguous"), F.lit(False).alias("names_cut"))
    return some.union(seeded)


def _fact(rows: DataFrame, kind: str, key: Column, paths: Column, unresolved: Column | None = None) -> DataFrame:
    ambiguous = F.col("ambiguous") if "ambiguous" in rows.columns else F.lit(False)
    return rows.select("query_id", "channel", F.lit(kind).alias("fact_type"), key.alias("fact_key"), F.array_compact(paths).alias("paths"), ambiguous.alias("ambiguous"), F.coalesce(unresolved if unresolved is not None else F.lit(False), F.lit(False)).alias("unresolved"))


def place(*columns: str) -> Column:
    return F.concat_ws(":", *columns)


def symbol_facts(found: DataFrame, facts: Facts) -> list[DataFrame]:
    known = index.with_ranges(facts.symbols, facts.symbol_ranges)
    files = F.array_distinct(F.array("declaration.file_path", "definition.file_path"))
    own = found.join(known, "identity")
    out = [_fact(own.where("channel = 'symbol'"), "symbol", F.col("identity"), files)]
    for side in ("declaration", "definition"):  # a side that isn't recorded is a fact without a place
        out.append(_fact(own.where(F.col("channel") == side), side, F.col("identity"), F.array(f"{side}.file_path"), F.col(side).isNull()))
    refs = found.where("channel = 'reference'").join(facts.references.distinct(), F.col("identity") == F.col("symbol_identity"))
    out.append(_fact(refs, "reference", place("identity", "file_path", "start_line", "start_column", "end_line", "end_column"), F.array("file_path")))
    for channel, kind, end in (("callers", "caller", "callee"), ("callees", "callee", "caller")):
        calls = index.calls(facts.relations, facts.symbols, facts.symbol_ranges, kind)
        met = found.where(F.col("channel") == channel).join(calls, F.col("identity") == F.col(end))
        out.append(_fact(met, "call", F.concat_ws(">", "caller", "callee"), F.array("file_path"), ~(F.col("caller_known") & F.col("callee_known"))))
    tests = found.where("channel = 'tests_for_symbol'").join(facts.test_references, F.col("identity") == F.col("symbol_identity"))
    return [*out, _fact(tests.select("query_id", "channel", "ambiguous", "case_identity", "identity", "file_path").distinct(), "test_mapping", F.concat_ws("|", "case_identity", "identity"), F.array("file_path"))]


def test_facts(queries: DataFrame, facts: Facts) -> list[DataFrame]:
    own = facts.entities.select("identity", "kind", "display_name", "file_path").distinct()
    out = []
    for channel, kind in (("test_cases", "case"), ("test_fixtures", "fixture")):
        met = queries.where(F.col("channel") == channel).join(own.where(F.col("kind") == kind), F.col("selector") == F.col("display_name"))
        out.append(_fact(met, "test", F.col("identity"), F.array("file_path")))
    cases = queries.where("channel = 'tests_for_fixture'").join(facts.fixture_cases, F.col("selector") == F.col("fixture_identity")).join(own.where("kind = 'case'"), F.col("case_identity") == F.col("identity"))
    return [*out, _fact(cases, "test", F.col("identity"), F.array("file_path"))]


def graph_facts(queries: DataFrame, facts: Facts) -> list[DataFrame]:
    """Nodes, and edges with an end outside the symbols' table unresolved."""
    sources = index.with_ranges(facts.symbols, facts.symbol_ranges).select(F.col("identity").alias("key"), F.coalesce("definition.file_path", "declaration.file_path").alias("file_path"))
    node = queries.where("channel = 'graph_node'").join(facts.nodes.select("namespace", "key").distinct(), F.col("selector") == F.col("key")).select("query_id", "channel", "key").join(sources, "key", "left")
    out = [_fact(node, "graph_node", F.col("key"), F.array("file_path"))]
    for channel, end in (("graph_incoming", "dst_key"), ("graph_outgoing", "src_key")):
        met = queries.where(F.col("channel") == channel).join(facts.edges.select(*graph.KEY).distinct(), F.col("selector") == F.col(end))
        for side in ("src", "dst"):
            met = met.join(sources.select(F.col("key").alias(f"{side}_key"), F.col("file_path").alias(f"{side}_file")), f"{side}_key", "left")
        out.append(_fact(met, "graph_edge", F.concat_ws(">", "src_key", "relation", "dst_key"), F.array("src_file", "dst_file"), F.col("src_file").isNull() | F.col("dst_file").isNull()))
    return out


def component_matches(names: DataFrame, components: DataFrame) -> DataFrame:
    """Components (key, display_name) that a text (selector) names by either."""
    return names.join(components.select(F.col("key").alias("selector"), F.col("key").alias("component")), "selector").union(names.join(components.select(F.col("display_name").alias("selector"), F.col("key").alias("component")), "selector")).distinct()


def domain_facts(queries: DataFrame, facts: Facts) -> list[DataFrame]:
    rows = facts.mapping.select("identity", "status", F.substring_index("candidates", "/", -1).alias("component"))
    members = queries.where("channel = 'domain_component' or channel = 'domain_members'").join(rows.where("status = 'recognized'"), F.col("selector") == F.col("component"))
    looked = queries.where("channel = 'domain_lookup'").join(rows, F.col("selector") == F.col("identity"))
    return [_fact(members, "domain_role", F.col("identity"), F.array().cast("array<string>")), _fact(looked, "domain_role", F.col("identity"), F.array().cast("array<string>"), F.col("status") != "recognized")]


@dataclass(frozen=True)
class Result:
    """Candidates within the bounds, a report for each query, and whether queries or candidates were cut."""

    candidates: DataFrame
    reports: DataFrame
    truncated: bool


def _bounded(offered: DataFrame, bound: DataFrame | None, bounds: Bounds) -> tuple[DataFrame, list[DataFrame], DataFrame, bool]:
    """Candidates of the facts offered, counts of each query, queries that lost a fact to ``bound``, and whether candidates were cut."""
    # each table is read once for all queries; what follows reads the facts that it gave
    if bounds.records_per_query is None:
        seen = offered = written(offered)
    else:
        by_key = Window.partitionBy("query_id").orderBy("fact_type", "fact_key")
        offered = written(offered.withColumn("before", F.sum("records").over(by_key) - F.col("records")))
        seen = offered.where(F.col("before") < bounds.records_per_query)
    if bound is not None:
        inside, lost = retrieval.within_fingerprint(seen, bound)
    else:
        inside, lost = seen, seen.select("query_id").where(F.lit(False))
    if bounds.results_per_query is None:
        kept = inside.withColumn("truncated", F.lit(False))
    else:
        kept = retrieval.first_n(inside, ["query_id"], ["fact_type", "fact_key"], bounds.results_per_query)
    # a channel admits candidates in the order of its queries and facts
    kept = written(kept.withColumn("candidate_id", retrieval.stable_id("fact_type", "fact_key")))
    taken = kept
    if bounds.candidates_per_channel is not None:
        first = kept.groupBy("channel", "candidate_id").agg(F.min(F.struct("query_id", "fact_type", "fact_key")).alias("first"))
        admitted = retrieval.first_n(first, ["channel"], ["first", "candidate_id"], bounds.candidates_per_channel).select("channel", "candidate_id")
        taken = kept.join(admitted, ["channel", "candidate_id"], "left_semi")
    candidates = written(retrieval.merged(taken))
    cut = bounds.candidates is not None and candidates.count() > bounds.candidates
    final = taken
    if cut:
        candidates = candidates.orderBy("candidate_id").limit(bounds.candidates)
        final = taken.join(candidates.select("candidate_id"), "candidate_id", "left_semi")
    facts_of = offered.groupBy("query_id").agg(F.sum("records").alias("observed"), (F.lit(False) if bounds.records_per_query is None else F.sum("records") > bounds.records_per_query).alias("records_cut"), F.bool_or("unresolved").alias("loose"))
    kept_of = kept.groupBy("query_id").agg(F.count("*").alias("offers"), F.max("truncated").alias("results_cut"))
    final_of = final.groupBy("query_id").agg(F.count("*").alias("kept"))
    return candidates, [facts_of, kept_of, final_of], lost, cut


def retrieve(queries: DataFrame, facts: Facts, bound: DataFrame | None = None, bounds: Bounds | None = None, failed: DataFrame | None = None) -> Result:
    """Run queries (query_id, channel, selector, qualified, by_identity) on their channels.

    ``bound``: paths of the snapshot's files; a fact with another path is dropped and its query unresolved. ``failed``:
    query_id and message of queries whose backend failed; they report a failure and no fact. Reports: query_id, channel,
    status, observed (facts offered), kept, diagnostics. Queries, records and results of a query, candidates of a channel
    and of the whole are cut in the order of their ids and keys.
    """
    bounds = bounds or Bounds()
    spark = queries.sparkSession
    own = queries.dropDuplicates(["query_id"])
    own = own if bounds.queries is None else own.orderBy("channel", "selector", "query_id").limit(bounds.queries)
    own = written(retrieval.guarded(own, bounds))
    broken = (failed if failed is not None else spark.createDataFrame([], "query_id string, message string")).dropDuplicates(["query_id"])
    live = own.where("refusal is null").join(broken.select("query_id"), "query_id", "left_anti")
    found = written(named(live, facts.symbols, bounds))
    offered = reduce(DataFrame.union, symbol_facts(found, facts) + test_facts(live, facts) + graph_facts(live, facts) + domain_facts(live, facts))
    offered = offered.groupBy("query_id", "channel", "fact_type", "fact_key").agg(F.first("paths").alias("paths"), F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("unresolved").alias("unresolved"), F.count("*").alias("records"))
    cuts = (bounds.records_per_query, bounds.results_per_query, bounds.candidates_per_channel, bounds.candidates)
    cut = False
    if bound is None and all(n is None for n in cuts):
        # nothing is cut, so reports sum the facts up as they come and nothing is written; candidates are derived where they are asked for
        lost = own.select("query_id").where(F.lit(False))
        candidates, no = retrieval.merged(offered), F.lit(False)
        counts = [offered.groupBy("query_id").agg(F.sum("records").alias("observed"), no.alias("records_cut"), F.bool_or("unresolved").alias("loose"), F.count("*").alias("offers"), no.alias("results_cut"), F.count("*").alias("kept"))]
    else:
        candidates, counts, lost, cut = _bounded(offered, bound, bounds)
    names_of = found.groupBy("query_id").agg(F.max("names_cut").alias("names_cut"), F.count("*").alias("names"))
    rows = own.select("query_id", "channel", "refusal", "by_identity", "selector")
    for part in (*counts, names_of, lost.withColumn("outside", F.lit(True)), broken.select("query_id", "message")):
        rows = rows.join(part, "query_id", "left")
    fixtures = facts.entities.where("kind = 'fixture'").select(F.col("identity").alias("selector"), F.lit(True).alias("fixture")).distinct()
    rows = rows.join(fixtures, "selector", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_seed = F.col("channel").isin(*SYMBOL_CHANNELS) & F.col("names").isNull() & (F.col("by_identity") | (F.col("channel") != "symbol"))
    no_fixture = (F.col("channel") == "tests_for_fixture") & F.col("fixture").isNull()
    over_channel = F.coalesce(F.col("kept"), F.lit(0)) < F.coalesce(F.col("offers"), F.lit(0))
    truncated = flag("records_cut") | flag("results_cut") | flag("names_cut") | over_channel
    unresolved = flag("loose") | flag("outside") | no_seed | no_fixture
    live_row = F.col("refusal").isNull() & F.col("message").isNull()
    status = F.when(F.col("message").isNotNull(), "failure").when(F.col("refusal").isNotNull(), F.col("refusal")).when(truncated, "truncated").when(unresolved, "unresolved").when(F.col("kept") > 0, "ok").otherwise("empty")
    notes = F.array_compact(F.array(
        F.col("message"), F.when(F.col("channel").isin(*retrieval.UNSUPPORTED_CHANNELS), "no_relation_provider"), F.when((F.col("refusal") == "truncated"), "query_character_limit"),
        F.when((F.col("refusal") == "unsupported") & ~F.col("channel").isin(*retrieval.UNSUPPORTED_CHANNELS), "several_lines"), F.when(live_row & flag("records_cut"), "record_limit"), F.when(live_row & flag("results_cut"), "result_limit"),
        F.when(live_row & flag("names_cut"), "name_limit"), F.when(live_row & over_channel, "candidate_limit"), F.when(live_row & flag("outside"), "source_outside_snapshot"), F.when(live_row & flag("loose"), "unresolved_end_source_or_role"),
        F.when(live_row & no_seed, "symbol_not_resolved"), F.when(live_row & no_fixture, "unknown_fixture"),
    ))
    reports = rows.select("query_id", "channel", status.alias("status"), F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.array_join(notes, ",").alias("diagnostics"))
    return Result(candidates, reports, cut)


def with_hashes(candidates: DataFrame, facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Candidates with the SHA-256 of each source that their facts (fact_type, fact_key, paths) name, in the order of paths."""
    own = facts.select("fact_type", "fact_key", F.explode("paths").alias("path")).distinct().join(inventory, "path")
    hashes = own.groupBy("fact_type", "fact_key").agg(F.array_sort(F.collect_set(F.struct("path", "sha256"))).alias("sources"))
    return candidates.join(hashes, ["fact_type", "fact_key"], "left")


def resolve_unique(found: DataFrame, key: str = "query_id") -> DataFrame:
    """key and state of a lookup that has to be unique: unique, or ambiguous."""
    return found.groupBy(key).agg(F.count("*").alias("candidates")).withColumn("state", F.when(F.col("candidates") == 1, "unique").otherwise("ambiguous"))
