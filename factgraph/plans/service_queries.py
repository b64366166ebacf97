"""Queries of retrieval, materialization, snapshots, dependency metadata and text forms, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import text
from factgraph.operators import changes, freshness, index, materialize, metrics, retrieval, service
from factgraph.plans.projection import fact
from factgraph.plans.queries import MAPPING_STATUS, MATCHES, ROLE, contained, joined, mapped_anchors, mapping, nodes_of, query, relation_items
from factgraph.sources import dependencies, files

# --- retrieval service

CHANNELS = ("symbol", "declaration", "definition", "reference", "callers", "callees")


def service_facts(spark: SparkSession, sf_dir: str) -> service.Facts:
    table = lambda t: fact(spark, sf_dir, t)
    return service.Facts(table("symbols"), table("symbol_ranges"), table("symbol_references"), table("symbol_relations"), table("test_entities"), table("test_fixture_cases"), contained(spark, sf_dir), nodes_of(spark, sf_dir), table("edges"), mapping(spark, sf_dir))


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name on every symbol channel, tests by name and fixture, suppliers as graph seeds, components, and what can't be answered."""
    one = lambda rows, channel, selector, by_identity=False: rows.select(F.lit(channel).alias("channel"), selector.cast("string").alias("selector"), F.lit(False).alias("qualified"), F.lit(by_identity).alias("by_identity")).distinct()
    part, supplier, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "region"))
    rows = [one(part, c, F.col("p_name")) for c in CHANNELS]
    rows += [one(supplier, c, F.concat(F.lit("supplier:"), "s_suppkey"), True) for c in ("graph_outgoing", "graph_node")]
    rows += [one(region, "domain_component", F.col("r_name")), one(region, "override", F.col("r_name")), one(region, "definition", F.concat(F.lit("no:"), "r_name"), True)]
    rows.append(one(fact(spark, sf_dir, "test_entities").where("kind = 'case'"), "test_cases", F.col("display_name")))
    rows.append(one(fact(spark, sf_dir, "test_entities").where("kind = 'fixture'"), "tests_for_fixture", F.concat(F.when(F.col("identity").endswith("7"), "no").otherwise(""), "identity")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("query_id", F.concat_ws("/", "channel", "selector"))


#: The query's SQL cuts nothing.
WIDE = retrieval.Bounds(queries=None, names=None, results_per_query=None, records_per_query=None, candidates_per_channel=None, candidates=None)
NAMED = "(SELECT DISTINCT p_name, concat('part:', p_partkey) AS identity FROM part) n"
REPORTS = f"""SELECT channel, selector, status, observed FROM (
    SELECT 'symbol' AS channel, p_name AS selector, 'ok' AS status, count(*) AS observed FROM {NAMED} GROUP BY p_name
    UNION ALL SELECT 'declaration', p_name, 'ok', count(*) FROM {NAMED} GROUP BY p_name
    UNION ALL SELECT 'definition', p_name, CASE WHEN bool_and(p_size % 2 = 0) THEN 'ok' ELSE 'unresolved' END, count(*) FROM part GROUP BY p_name
    UNION ALL SELECT 'reference', p_name, CASE WHEN count(r.file_path) > 0 THEN 'ok' ELSE 'empty' END, count(r.file_path) FROM {NAMED} LEFT JOIN symbol_references r ON r.symbol_identity = n.identity GROUP BY p_name
    UNION ALL SELECT 'callers', p_name, CASE WHEN count(r.source_identity) > 0 THEN 'ok' ELSE 'empty' END, count(r.source_identity) FROM {NAMED} LEFT JOIN symbol_relations r ON r.relation_kind = 'caller' AND r.source_identity = n.identity GROUP BY p_name
    UNION ALL SELECT 'callees', p_name, 'empty', 0 FROM {NAMED} GROUP BY p_name
    UNION ALL SELECT 'graph_outgoing', concat('supplier:', s_suppkey), CASE WHEN count(e.dst_key) > 0 THEN 'ok' ELSE 'empty' END, count(e.dst_key) FROM supplier LEFT JOIN edges e ON e.src_key = concat('supplier:', s_suppkey) GROUP BY s_suppkey
    UNION ALL SELECT 'graph_node', concat('supplier:', s_suppkey), 'ok', 1 FROM supplier
    UNION ALL SELECT 'domain_component', r_name, CASE WHEN coalesce(m.n, 0) > 0 THEN 'ok' ELSE 'empty' END, coalesce(m.n, 0) FROM region LEFT JOIN (SELECT r.component, count(DISTINCT x.identity) AS n FROM ({ROLE}) x JOIN symbols s ON s.identity = x.identity JOIN rules r ON r.qualified_name = s.qualified_name JOIN symbol_ranges g ON g.symbol_identity = s.identity AND g.file_path = r.file_path WHERE x.reason = 'exact_catalog_match' GROUP BY 1) m ON m.component = r_name
    UNION ALL SELECT 'override', r_name, 'unsupported', 0 FROM region UNION ALL SELECT 'definition', concat('no:', r_name), 'unresolved', 0 FROM region
    UNION ALL SELECT 'test_cases', display_name, 'ok', count(DISTINCT identity) FROM test_entities WHERE kind = 'case' GROUP BY display_name
    UNION ALL SELECT 'tests_for_fixture', CASE WHEN f.identity LIKE '%7' THEN 'no' ELSE '' END || f.identity, CASE WHEN f.identity LIKE '%7' THEN 'unresolved' WHEN count(c.case_identity) > 0 THEN 'ok' ELSE 'empty' END, CASE WHEN f.identity LIKE '%7' THEN 0 ELSE count(c.case_identity) END FROM (SELECT DISTINCT identity FROM test_entities WHERE kind = 'fixture') f LEFT JOIN test_fixture_cases c ON c.fixture_identity = f.identity GROUP BY f.identity) q"""


@query(REPORTS, "symbols", "symbol_ranges", "symbol_references", "symbol_relations", "test_entities", "test_fixture_cases", "edges", "rules")
def retrieve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = name_queries(spark, sf_dir)
    found = service.retrieve(queries, service_facts(spark, sf_dir), bounds=WIDE)
    return found.reports.join(queries.select("query_id", "selector"), "query_id").select("channel", "selector", "status", "observed")


@query(
    f"""SELECT p_name AS selector, 'truncated' AS status, least(n, 3) AS kept FROM (SELECT p_name, count(*) AS n FROM {NAMED} GROUP BY p_name HAVING count(*) > 3) UNION ALL SELECT p_name, 'ok', count(*) FROM {NAMED} GROUP BY p_name HAVING count(*) <= 3"""
)
def retrieval_name_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = name_queries(spark, sf_dir).where("channel = 'symbol'")
    bounds = retrieval.Bounds(queries=10**6, names=3, candidates_per_channel=10**6, candidates=10**6)
    found = service.retrieve(queries, service_facts(spark, sf_dir), bounds=bounds)
    return found.reports.join(queries.select("query_id", "selector"), "query_id").select("selector", "status", "kept")


@query("SELECT 'new' AS side, channel, concat('part:', p_partkey) AS selector FROM part, unnest(['symbol', 'declaration']) AS t(channel) UNION ALL SELECT 'new', 'graph_node', concat('supplier:', s_suppkey) FROM supplier")
def change_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("symbol").alias("seed_kind"), F.concat(F.lit("part:"), "p_partkey").alias("key")).union(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("graph"), F.concat(F.lit("supplier:"), "s_suppkey")))
    return service.change_queries(seeds, "new", ("symbol", "declaration", "graph_node")).select("side", "channel", "selector")


@query(
    f"SELECT DISTINCT side, 'symbol' AS seed_kind, symbol_identity AS key FROM ({MATCHES}) m JOIN ({MAPPING_STATUS}) s ON s.anchor_id = m.anchor_id JOIN (SELECT concat('a', p_partkey) AS anchor_id, CAST(CASE WHEN p_partkey % 40 >= 6 THEN 0 ELSE p_partkey % 40 END AS bigint) AS side FROM part) k ON k.anchor_id = m.anchor_id WHERE s.status IN ('mapped', 'truncated')",
    "anchors", "symbol_ranges",
)
def mapping_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only anchors that are mapped, or mapped up to a limit, give seeds."""
    anchors, matches, statuses = mapped_anchors(spark, sf_dir)
    return changes.mapping_seeds(statuses, matches, anchors)


@query("SELECT 'symbol' AS fact_type, 'part:' || p_partkey AS fact_key, sha256(p_brand) AS sha256 FROM part")
def candidate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    facts = part.select(F.lit("symbol").alias("fact_type"), F.concat(F.lit("part:"), "p_partkey").alias("fact_key"), F.array(F.concat(F.lit("src/"), "p_brand", F.lit(".cpp"))).alias("paths"))
    inventory = files.inventory(part.select(F.concat(F.lit("src/"), "p_brand", F.lit(".cpp")).alias("path"), F.col("p_brand").alias("content")).distinct())
    return service.with_hashes(facts.select("fact_type", "fact_key"), facts, inventory).select("fact_type", "fact_key", F.col("sources")[0]["sha256"].alias("sha256"))


@query("SELECT p_name AS query_id, count(*) AS candidates, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM part GROUP BY p_name")
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.resolve_unique(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("query_id"), "p_partkey"))


@query("SELECT DISTINCT n_name AS selector, concat('c', n_nationkey) AS component FROM nation UNION SELECT concat('c', n_nationkey), concat('c', n_nationkey) FROM nation WHERE n_nationkey % 2 = 0")
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("key", F.concat(F.lit("c"), "n_nationkey"))
    names = nation.select(F.col("n_name").alias("selector")).union(nation.where("n_nationkey % 2 = 0").select("key"))
    return service.component_matches(names, nation.select("key", F.col("n_name").alias("display_name"))).select("selector", "component")


# --- materialization

KINDS = "['node', 'relation', 'association', 'binding', 'evidence', 'range', 'fact', 'change']"


@query(f"SELECT kind, CASE kind WHEN 'node' THEN 'nodes' WHEN 'relation' THEN 'relations' WHEN 'association' THEN 'associations' WHEN 'binding' THEN 'bindings' ELSE 'supporting' END AS bucket, count(*) AS n FROM (SELECT {KINDS}[CAST(1 + l_partkey % 8 AS bigint)] AS kind FROM lineitem) GROUP BY kind")
def context_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k.strip("' ")) for k in KINDS.strip("[]").split(",")))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("candidate_id"), F.element_at(kinds, (1 + F.col("l_partkey") % 8).cast("int")).alias("kind"))
    return materialize.buckets(rows).groupBy("kind", "bucket").agg(F.count("*").alias("n"))


@query("SELECT concat('part:', p_partkey) AS candidate_id, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS places, CASE WHEN count(l_orderkey) = 0 THEN 'endpoint_not_observed' WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'endpoint_source_unresolved' END AS note FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def node_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part:"), "p_partkey").alias("candidate_id"), F.lit("target").alias("side"), F.col("p_partkey").alias("identity"))
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("target").alias("side"), F.col("l_partkey").alias("identity"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("place"))
    return materialize.node_places(nodes, facts).select("candidate_id", F.size("places").cast("long").alias("places"), "note")


@query("SELECT concat('customer:', c_custkey) AS root, CAST(3 AS bigint) AS needs FROM customer UNION ALL SELECT concat('nation:', n_nationkey), 2 FROM nation UNION ALL SELECT concat('region:', r_regionkey), 1 FROM region")
def context_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers need their nation, nations their region: how much each one holds with all it needs."""
    customer, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    ids = customer.select(key("customer", "c_custkey").alias("candidate_id")).union(nation.select(key("nation", "n_nationkey"))).union(region.select(key("region", "r_regionkey")))
    needs = customer.select(key("customer", "c_custkey").alias("candidate_id"), key("nation", "c_nationkey").alias("needs")).union(nation.select(key("nation", "n_nationkey"), key("region", "n_regionkey")))
    return materialize.closure(ids, needs)[0].groupBy("root").agg(F.count("*").alias("needs"))


@query("SELECT invariant, count(*) AS n FROM (SELECT 'open_dependency' AS invariant FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT 'repeated_id' FROM part WHERE p_partkey % 10 = 4 UNION ALL SELECT 'snippet_without_candidate' FROM part WHERE p_partkey % 10 = 5 UNION ALL SELECT 'offset_outside_backing' FROM part WHERE p_partkey % 10 = 6) GROUP BY invariant")
def output_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    digit, ids = F.col("p_partkey") % 10, part.select(F.col("p_partkey").cast("string").alias("candidate_id"), (F.col("p_partkey") % 10).alias("d"))
    candidates = ids.where("d <> 5").union(ids.where("d = 4")).select("candidate_id")
    needs = part.where(digit == 3).select(F.col("p_partkey").cast("string").alias("candidate_id"), F.lit("absent").alias("needs"))
    statuses = part.where(digit.isin(5, 6, 7)).select(F.col("p_partkey").cast("string").alias("candidate_id"), F.lit("available").alias("status"), F.lit(0).alias("start_offset"), F.when(digit == 6, 9).otherwise(2).alias("end_offset"), F.lit("ab").alias("snippet"))
    return materialize.broken_invariants(candidates, needs, statuses).groupBy("invariant").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS seed, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS nodes, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS edges, count(DISTINCT l_orderkey) AS files, count(*) FILTER (l_returnflag = 'N') AS paths FROM lineitem GROUP BY 1")
def observation_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("seed"), F.when(F.col("l_returnflag") == "R", "node").when(F.col("l_returnflag") == "A", "edge").otherwise("path").alias("kind"), F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("path"))
    return materialize.inventory(rows)


# --- snapshots

SNAPSHOT = """SELECT o_orderkey AS k, o_orderkey % 11 = 1 AS no_source, o_orderkey % 11 = 2 AS dirty, o_orderkey % 11 = 3 AS drift, o_orderkey % 11 = 4 AS toolchain, o_orderkey % 11 = 5 AS unverified, o_orderkey % 11 = 6 AS no_artifacts, o_orderkey % 7 = 1 AS building, o_orderkey % 7 = 2 AS failed, o_orderkey % 5 = 1 AS narrow, o_orderkey % 13 = 1 AS other_revision FROM orders"""


@query(
    f"""SELECT k AS snapshot_id, CASE WHEN building THEN 'building' WHEN failed THEN 'failed' WHEN u THEN 'unknown' WHEN s THEN 'stale' ELSE 'fresh' END AS state, CASE WHEN u THEN 'unknown' WHEN s THEN 'stale' ELSE 'fresh' END AS snapshot_state, CASE WHEN narrow THEN 'insufficient' ELSE 'sufficient' END AS coverage,
    NOT building AND NOT failed AND NOT u AND NOT s AND NOT narrow AS can_bind, array_to_string(list_sort(list_filter([CASE WHEN no_source THEN 'source_unavailable' END, CASE WHEN dirty THEN 'dirty_workspace' END, CASE WHEN drift THEN 'source_drift' END, CASE WHEN toolchain THEN 'toolchain_mismatch' END, CASE WHEN unverified THEN 'unverified_provenance' END,
    CASE WHEN no_artifacts THEN 'artifact_unavailable' END, CASE WHEN building THEN 'latest_building' END, CASE WHEN failed THEN 'latest_failed' END, CASE WHEN narrow THEN 'scope_insufficient' END, CASE WHEN other_revision THEN 'revision_mismatch' END], lambda x: x IS NOT NULL)), ',') AS reasons
    FROM (SELECT *, no_source OR unverified OR no_artifacts AS u, dirty OR drift OR toolchain OR other_revision AS s FROM ({SNAPSHOT}) a) x"""
)
def snapshot_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness_states(spark, sf_dir).select("snapshot_id", "state", "snapshot_state", "coverage", "can_bind", joined("reasons"))


def freshness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lit = F.col("o_orderkey"), F.lit
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", k.alias("snapshot_id"))
    snapshots = rows.select("snapshot_id", lit("r").alias("repository"), lit("v1").alias("revision"), lit("selected").alias("scope_kind"), F.when(k % 5 == 1, F.array(lit("a"))).otherwise(F.array(lit("a"), lit("b"))).alias("scope_files"), lit("s").alias("source_sha256"), lit("s").alias("build_sha256"), (k % 11 != 5).alias("verified"), (k % 11 != 6).alias("artifacts_ok"), F.when(k % 7 == 1, "building").when(k % 7 == 2, "cancelled").alias("attempt"), lit("c").alias("configuration"), lit("t").alias("toolchain"), lit("p").alias("rules"))
    wanted = rows.select("snapshot_id", lit("r").alias("repository"), F.when(k % 13 == 1, "v2").otherwise("v1").alias("revision"), lit("selected").alias("scope_kind"), F.array(lit("b"), lit("a")).alias("scope_files"), lit("c").alias("configuration"), F.when(k % 11 == 4, "t2").otherwise("t").alias("toolchain"), lit("p").alias("rules"))
    sources = rows.where("o_orderkey % 11 <> 1").select("snapshot_id", lit("r").alias("repository"), lit("v1").alias("revision"), F.when(k % 11 == 3, "s2").otherwise("s").alias("sha256"), (k % 11 == 2).alias("dirty"), lit(False).alias("untracked"))
    return freshness.evaluate(snapshots, wanted, sources)


@query(f"SELECT k AS snapshot_id, CASE WHEN k % 17 = 0 THEN 'conflict' WHEN k % 19 = 0 THEN 'rejected' WHEN k % 2 = 0 AND NOT (building OR failed OR no_source OR unverified OR no_artifacts OR dirty OR drift OR toolchain OR other_revision OR narrow) THEN 'no_op' ELSE 'build' END AS outcome FROM ({SNAPSHOT}) x")
def refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("snapshot_id"), (k % 2 != 0).alias("forced"), (k % 17 == 0).alias("leased"), (k % 19 != 0).alias("clean"))
    return freshness.refresh_outcome(freshness_states(spark, sf_dir), requests)


@query("SELECT path, path NOT LIKE 'build/%' AND path NOT LIKE 'lib/Out/%' AS in_scope FROM paths WHERE path LIKE '%1%'", "paths")
def refresh_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = fact(spark, sf_dir, "paths")
    inside, outside = freshness.resolved_scope(tracked, "selected", tracked.where("path like '%1%'"))
    return inside.select("path", F.lit(True).alias("in_scope")).union(outside.select("path", F.lit(False)))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 6 = 1 THEN 'missing_artifact' WHEN p_partkey % 6 = 2 THEN 'hash_mismatch' WHEN p_partkey % 6 = 3 THEN 'schema_mismatch' END AS kind FROM part UNION ALL SELECT 'scope_not_indexed' FROM part WHERE p_partkey % 6 = 4) WHERE kind IS NOT NULL GROUP BY kind")
def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 6
    named = part.select(F.concat(F.lit("a/"), "p_partkey").alias("path"), F.sha2("p_name", 256).alias("sha256"), F.lit(3).alias("schema_version"), k.alias("k"))
    stored = named.where("k <> 1").select("path", F.when(F.col("k") == 2, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("k") == 3, 2).otherwise(3).alias("schema_version"))
    return freshness.artifact_problems(named.drop("k"), stored, named.where("k <> 4"), named).groupBy("kind").agg(F.count("*").alias("n"))


# --- dependency metadata


@query("SELECT concat('tu', o_orderkey) AS tu, CASE WHEN o_orderkey % 4 = 0 THEN concat('own', o_orderkey) WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN concat('src', o_custkey) END AS depfile FROM orders")
def registered_depfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("tu"), "o_orderkey").alias("tu"), F.col("o_custkey").alias("source"), "o_orderkey")
    own = orders.where("o_orderkey % 4 = 0").select("tu", F.concat(F.lit("own"), "o_orderkey").alias("depfile"))
    shared = orders.select("source", F.concat(F.lit("src"), "source").alias("depfile")).distinct()
    return dependencies.registered(orders, own, shared).select("tu", "depfile")


@query("SELECT 'path' AS what, concat('tu', o_orderkey) AS tu, unnest([concat('src/', o_orderkey, '.cpp'), concat('inc/', o_custkey, '.h')]) AS value FROM orders WHERE o_orderkey % 9 > 1 UNION ALL SELECT 'outside_repository_dependency', concat('tu', o_orderkey), '1' FROM orders WHERE o_orderkey % 9 > 1 UNION ALL SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'missing_dependency_metadata' ELSE 'malformed_metadata' END, concat('tu', o_orderkey), '1' FROM orders WHERE o_orderkey % 9 < 2")
def dependency_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.concat(F.lit("tu"), k).alias("tu"), F.concat(F.lit("src/"), k, F.lit(".cpp")).alias("source"), F.concat(F.lit("d/"), k).alias("depfile"))
    depfiles = orders.where("o_orderkey % 9 > 1").select(F.col("depfile").alias("path"), F.concat(F.lit("x.o: "), "source", F.lit(" /usr/h.h inc/"), "o_custkey", F.lit(".h\n")).alias("content"))
    rows, notes = dependencies.closures(orders, orders.where("o_orderkey % 9 <> 0").select("tu", "depfile"), orders.limit(0).select("source", "depfile"), depfiles)
    return rows.select(F.lit("path").alias("what"), "tu", F.col("path").alias("value")).union(notes.select("code", "tu", F.col("n").cast("string")))


@query("SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) WHEN 3 THEN 'unknown' WHEN 2 THEN 'partial' ELSE 'complete' END AS coverage FROM lineitem GROUP BY l_orderkey")
def coverage_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "unknown").when(F.col("l_returnflag") == "A", "partial").otherwise("complete").alias("coverage"))
    return dependencies.widest(rows, by=["l_orderkey"])


@query("SELECT concat('tu:', o_orderkey) AS tu, CASE WHEN o_orderkey % 10 <> 0 THEN 'missing' ELSE 'unexpected' END AS mismatch FROM orders WHERE (o_orderkey % 10 <> 0) <> (o_orderkey % 7 <> 0)", "contexts")
def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact(spark, sf_dir, "contexts")
    return dependencies.unit_coverage(rows.where("side = 'old'"), rows.where("side = 'new'"))


@query("SELECT source, contexts, count(DISTINCT tu) AS units FROM (SELECT concat('c', c_nationkey) AS source, c_custkey AS tu, count(*) OVER (PARTITION BY c_nationkey) AS contexts FROM customer) GROUP BY ALL")
def context_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), "c_nationkey").alias("source"), F.lit("/w").alias("directory"), F.array(F.lit("-c"), F.col("c_custkey").cast("string")).alias("arguments"), F.array(F.struct(F.lit("a.cfg").alias("path"), F.lit("0").alias("sha256"))).alias("inputs"))
    return dependencies.units(rows).groupBy("source", "contexts").agg(F.count_distinct("tu").alias("units"))


@query("SELECT c_custkey, 3 + c_custkey % 2 AS words, CASE WHEN c_custkey % 2 = 1 THEN 'a b' ELSE c_name END AS last FROM customer".replace("3 + c_custkey % 2 AS words", "CAST(3 + c_custkey % 2 AS int) AS words"))
def command_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("cc -c '"), "c_name", F.lit("'"), F.when(F.col("c_custkey") % 2 == 1, ' "a b"').otherwise("")).alias("command"))
    return dependencies.split_command(rows).select("c_custkey", F.size("arguments").alias("words"), F.element_at("arguments", -1).alias("last"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 8 = 0 THEN 'kind_disagrees' WHEN p_partkey % 8 = 1 THEN 'conflicting_old_path' END AS problem FROM part UNION ALL SELECT 'conflicting_old_path' FROM part WHERE p_partkey % 8 = 1) GROUP BY problem")
def change_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 8).alias("d"), F.concat(F.lit("f/"), "p_partkey").alias("f"))
    rows = p.select(F.col("f").alias("old_path"), F.col("f").alias("new_path"), F.when(F.col("d") == 0, "rename").otherwise("modify").alias("kind"))
    twice = p.where("d = 1").select(F.col("f").alias("old_path"), F.concat(F.lit("g/"), "f").alias("new_path"), F.lit("rename").alias("kind"))
    return dependencies.change_problems(rows.union(rows).union(twice)).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT concat('fixture:', user_id) AS identity FROM events WHERE user_id % 3 = 0 GROUP BY user_id", "test_entities")
def mixed_test_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact(spark, sf_dir, "test_entities").select("identity", "kind")
    own = rows.where("kind = 'fixture'").where("cast(substring(identity, 9) as long) % 3 = 0").select("identity", F.lit("case").alias("kind"))
    return index.mixed_kinds(rows.union(own))


# --- metrics and text forms


@query(
    """SELECT count(*) AS cases, count(*) FILTER (case_id LIKE '%1') AS traces, CAST(count(*) FILTER (case_id LIKE '%1' AND missing = 0) AS double) / count(*) FILTER (case_id LIKE '%1') AS chain_accuracy, CAST(sum(present) AS double) / sum(expected) AS relation_coverage, sum(missing)::bigint AS missing, sum(incorrect)::bigint AS incorrect
    FROM (SELECT case_id, count(*) FILTER (w) AS expected, count(*) FILTER (w AND h) AS present, count(*) FILTER (w AND NOT h) AS missing, count(*) FILTER (h AND NOT w) AS incorrect FROM (SELECT case_id, item, bool_or(k = 'w') AS w, bool_or(k = 'h') AS h FROM (SELECT DISTINCT concat('s', l_suppkey) AS case_id, CAST(l_partkey AS varchar) AS item, 'w' AS k FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT DISTINCT concat('s', l_suppkey), CAST(l_partkey AS varchar), 'h' FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL) GROUP BY case_id) x"""
)
def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.relation_coverage(*relation_items(spark, sf_dir))
    return metrics.relation_summary(found, found.where("case_id like '%1'").select("case_id", F.when(F.col("missing") == 0, 1.0).otherwise(0.0).alias("chain_correct")))


@query("SELECT 'gaps' AS what, 'g' || l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'status', l_returnflag, count(*) FROM lineitem GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.array(F.concat(F.lit("g"), "l_linenumber")).alias("gaps"), F.array("l_returnflag").alias("status"))
    return metrics.label_counts(rows, ["gaps", "status"])


@query(
    """SELECT p_partkey, p_partkey % 3 > 0 AS is_hash, p_partkey % 4 = 0 AS is_time, sha256(concat('a', chr(10), p_name, chr(10), 'b', chr(10))) AS normalized, CASE WHEN length(p_name) <= 15 THEN p_name ELSE concat(left(p_name, 3), ' [cut:] ', right(p_name, 3)) END AS bounded, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE concat(p_brand, '::', p_name) END AS qualified FROM part"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("p_partkey"), F.col
    digest = F.when(k % 3 > 0, F.sha2("p_name", 256)).otherwise(F.upper(F.sha2("p_name", 256)))
    moment = F.when(k % 4 == 0, "2024-02-29T10:11:12Z").when(k % 4 == 1, "2024-02-29T10:11:12").when(k % 4 == 2, "2023-02-29T10:11:12Z").otherwise("soon")
    raw = F.concat(F.lit("a\r\n"), "p_name", F.lit("\rb\n"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.is_sha256(digest).alias("is_hash"), text.is_timestamp(moment).alias("is_time"), text.normalized_sha256(raw).alias("normalized"), text.bounded_message(c("p_name"), 15).alias("bounded"), text.qualified_name(F.when(k % 5 == 0, "").otherwise(F.concat("p_brand", F.lit("::"))), c("p_name")).alias("qualified"))
