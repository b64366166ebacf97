"""Queries of bounded expansion and of traces, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import creation_trace, expansion, framework, property_trace
from factgraph.operators import layout_trace as layout_trace_of
from factgraph.plans import codebase
from factgraph.plans.projection import duck_text, fact
from factgraph.plans.queries import nodes_of, query

# --- bounded expansion

#: Jobs one after the other: {s} has a name for i (from 1 on), a, nodes, edges of each job; a job is taken if the held nodes and edges stay within the caps.
GREEDY = """{g}(i, held, ne, ok) AS (SELECT CAST(0 AS bigint), list_filter(['x'], lambda x: x = 'y'), CAST(0 AS bigint), false UNION ALL SELECT s.i, CASE WHEN len(list_distinct(list_concat(g.held, s.nodes))) <= {nodes} AND g.ne + s.ne <= {edges} THEN list_distinct(list_concat(g.held, s.nodes)) ELSE g.held END,
    CASE WHEN len(list_distinct(list_concat(g.held, s.nodes))) <= {nodes} AND g.ne + s.ne <= {edges} THEN g.ne + s.ne ELSE g.ne END, len(list_distinct(list_concat(g.held, s.nodes))) <= {nodes} AND g.ne + s.ne <= {edges} FROM {g} g JOIN {s} s ON s.i = g.i + 1)"""
#: What stands against a job that isn't taken, given what is held in front of it.
AGAINST = "concat('depth_scope:1', CASE WHEN g.ok THEN '' ELSE concat(CASE WHEN b.ne + s.ne > {edges} THEN ',global_edge_limit' ELSE '' END, CASE WHEN len(list_distinct(list_concat(b.held, s.nodes))) > {nodes} THEN ',global_node_limit' ELSE '' END) END)"
REPORT = "SELECT {side}s.a AS key, CASE WHEN g.ok AND s.ne = s.n THEN 'ok' ELSE 'truncated' END AS status, " + AGAINST + " AS diagnostics, CASE WHEN g.ok THEN len(s.nodes) ELSE 0 END AS n_nodes, CASE WHEN g.ok THEN s.ne ELSE 0 END AS n_edges FROM {s} s JOIN {g} g ON g.i = s.i JOIN {g} b ON b.i = s.i - 1"


def search_sql(name: str, source: str, most: int) -> str:
    """Searches one step deep over rows a, b, each with one edge: at most ``most`` new nodes."""
    return f"{name} AS (SELECT row_number() OVER (ORDER BY a) AS i, a, list_append(list(b), a) AS nodes, count(*) AS ne, max(n) AS n FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS k, count(*) OVER (PARTITION BY a) AS n FROM (SELECT DISTINCT a, b FROM ({source}) d) e) f WHERE k <= {most} GROUP BY a)"


CALLED = "SELECT concat('supplier:', l_suppkey) AS a, concat('part:', l_partkey) AS b FROM lineitem"


@query("WITH RECURSIVE " + search_sql("s", CALLED, 7) + ", " + GREEDY.format(g="g", s="s", nodes=90, edges=400) + " " + REPORT.format(side="", s="s", g="g", nodes=90, edges=400))
def expand_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("symbol").alias("namespace"), F.concat(F.lit("supplier:"), "s_suppkey").alias("key"))
    policy = expansion.Policy(depth=1, nodes_per_seed=8, queries=10**9, nodes=90, edges=400)
    found = expansion.expand_seeds(nodes_of(spark, sf_dir), fact(spark, sf_dir, "edges"), start, policy, relations=["call"])
    return found.reports.select("key", "status", "diagnostics", "n_nodes", "n_edges")


def sided(flag: str) -> str:
    return f"SELECT concat('part:', l_partkey) AS a, concat('supplier:', l_suppkey) AS b FROM lineitem WHERE l_returnflag {flag} 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 4)"


NEW = dict(s="sn", g="gn", nodes=60, edges=100)
LEFT = dict(s="so", g="go", nodes="(60 - (SELECT max(len(held)) FROM gn))", edges="(100 - (SELECT max(ne) FROM gn))")


@query("WITH RECURSIVE " + search_sql("sn", sided("<>"), 3) + ", " + search_sql("so", sided("="), 3) + ", " + GREEDY.format(**NEW) + ", " + GREEDY.format(**LEFT) + " " + REPORT.format(side="'new' AS side, ", **NEW) + " UNION ALL " + REPORT.format(side="'old' AS side, ", **LEFT))
def expand_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sides = []
    for flag in (F.col("l_returnflag") != "R", F.col("l_returnflag") == "R"):
        rows = line.where(flag)
        edges = rows.select(F.lit("symbol").alias("src_ns"), F.concat(F.lit("supplier:"), "l_suppkey").alias("src_key"), F.lit("symbol").alias("dst_ns"), F.concat(F.lit("part:"), "l_partkey").alias("dst_key"), F.lit("call").alias("relation"))
        small = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 4").select(F.col("p_partkey").alias("l_partkey"))
        start = rows.join(small, "l_partkey", "left_semi").select(F.lit("symbol").alias("namespace"), F.concat(F.lit("part:"), "l_partkey").alias("key"))
        sides.append((nodes_of(spark, sf_dir), edges, start))
    policy = expansion.Policy(depth=1, nodes_per_seed=4, queries=10**9, nodes=60, edges=100)
    outcomes = expansion.expand_change(*sides, policy, direction="incoming")
    columns = ("key", "status", "diagnostics", "n_nodes", "n_edges")
    new, old = (o.reports.select(F.lit(side).alias("side"), *columns) for side, o in zip(("new", "old"), outcomes, strict=True))
    return new.union(old)


# --- framework relations

#: What each method is, by the numbers its text was made of.
OWNED = f"SELECT *, {codebase.CLASS_ROLE} AS role, CASE WHEN odd = 6 THEN 24 WHEN p % 2 = 0 THEN p % 5 ELSE 5 + p % 5 END AS target FROM ({duck_text(codebase.METHODS)}) m"
PROVED = """CASE WHEN odd = 1 THEN 'missing_definition' WHEN odd = 2 THEN 'unsupported_body_template' WHEN odd = 3 THEN 'missing_reference' WHEN odd = 4 THEN 'ambiguous_reference' WHEN odd = 6 THEN 'unknown_ambiguous_or_cross_component_target'
    WHEN role = 'pattern' AND odd = 5 THEN 'missing_or_ambiguous_semantic_factory_call' WHEN role = 'model' AND p % 2 = 1 THEN 'unsupported_macro_definition' END"""


@query(
    f"""WITH o AS ({OWNED}), known AS (SELECT * FROM o WHERE odd <> 9 AND role IN ('pattern', 'model')) SELECT concat('method:', p) AS source, NULL AS target, NULL AS relation, 'owner' AS rule, 'missing_semantic_parent' AS diagnostic FROM o WHERE odd = 9
    UNION SELECT concat('class:', class_no), NULL, NULL, 'role', role FROM o WHERE role NOT IN ('pattern', 'model') UNION SELECT 'frame', NULL, NULL, 'role', 'missing_role' UNION SELECT concat('make:', p), NULL, NULL, 'body', CASE WHEN v IN (1, 12) THEN 'missing_definition' ELSE 'unsupported_body_template' END FROM o WHERE role IN ('pattern', 'model') UNION SELECT concat('class:', class_no), concat('method:', p), 'measure', 'operation', CASE WHEN odd = 8 THEN 'unsupported_declaration_template' END FROM known WHERE odd IN (7, 8)
    UNION SELECT concat('method:', p), CASE WHEN odd NOT IN (1, 2, 3, 4) THEN concat('nation:', target) END, CASE WHEN odd NOT IN (1, 2) THEN CASE role WHEN 'pattern' THEN 'create' ELSE 'update_property' END END, 'body', {PROVED} FROM known WHERE odd NOT IN (7, 8)
    UNION SELECT concat('case:', l_orderkey), concat('method:', l_partkey), 'test', 'test', NULL FROM lineitem JOIN o ON o.p = l_partkey WHERE l_linenumber = 1 AND odd <> 9 AND role IN ('pattern', 'model')
    UNION SELECT CASE WHEN odd = 9 THEN concat('method:', p) ELSE concat('class:', class_no) END, NULL, NULL, 'role', CASE WHEN odd = 9 THEN 'missing_role' ELSE role END FROM lineitem JOIN o ON o.p = l_partkey WHERE l_linenumber = 1 AND (odd = 9 OR role NOT IN ('pattern', 'model')) UNION SELECT 'mock', NULL, NULL, 'mock', 'unsupported_mock_facts'"""
)
def framework_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1").select(F.concat(F.lit("case:"), "l_orderkey").alias("case_identity"), F.concat(F.lit("method:"), "l_partkey").alias("symbol_identity"))
    return framework.framework_relations(**codebase.tables(spark, sf_dir), tests=tests, **codebase.templates(spark))


# --- property traces

COMPONENTS = [("comp0",), ("comp1",)]
#: Paths from the entry of each method, chains from its property on, and what is missing, by the numbers.
PROPERTY = f"""o AS ({OWNED}), b AS (SELECT *, role = 'model' AND odd IN (0, 5) AND p % 2 = 0 AS bound, CASE WHEN odd = 9 OR role NOT IN ('model', 'ambiguous') THEN 'unknown_or_cross_component_model' WHEN role = 'ambiguous' THEN 'ambiguous_model_role' END AS g1,
    CASE WHEN role = 'model' THEN CASE odd WHEN 3 THEN 'missing_property_reference' WHEN 4 THEN 'ambiguous_property_identity' WHEN 6 THEN 'ambiguous_property_role_conflict' END END AS g2, CASE WHEN odd <> 9 AND role = 'ambiguous' THEN 'ambiguous_call_role' END AS g3 FROM o),
    d AS (SELECT p, concat('entry:', p, '>method:', p) AS path, true AS ended FROM o WHERE p % 3 = 1 OR p % 7 = 0 UNION ALL SELECT p, concat('entry:', p, '>mid:', p, '>method:', p), true FROM o WHERE p % 3 = 0 OR p % 7 = 0 UNION ALL SELECT p, concat('entry:', p), false FROM o WHERE p % 3 = 2 AND p % 7 <> 0),
    t(k, rest, g4) AS (VALUES (0, '>update:N>width:N>get:N>consumer:N', NULL), (1, '', 'missing_property_writer'), (2, '>update:N', 'unsupported_property_write'), (3, '>update:N>width:N', 'missing_downstream_consumer'), (4, '>update:N>width:N>get:N>consumer:N', NULL), (4, '>update:N>width:N>get:N>consumer2:N', NULL)),
    r AS (SELECT b.p, d.path, CASE WHEN ended AND bound THEN concat('nation:', target, replace(t.rest, 'N', CAST(target AS varchar))) ELSE '' END AS chain, array_to_string(list_sort(list_filter(CASE WHEN ended THEN [g1, g2, g3, CASE WHEN g1 IS NULL AND g2 IS NULL AND NOT bound THEN 'missing_update_binding' END, CASE WHEN bound THEN t.g4 END, CASE WHEN b.p % 11 = 0 THEN 'missing_source_location' END]
    ELSE ['missing_setter_call'] END, lambda x: x IS NOT NULL)), ',') AS gaps FROM b JOIN d ON d.p = b.p LEFT JOIN t ON ended AND bound AND t.k = target % 5)"""


@query(f"WITH {PROPERTY} SELECT r.p AS trace, path, chain, gaps, CASE WHEN n > 1 OR vague THEN 'ambiguous' WHEN gaps = '' THEN 'complete' ELSE 'incomplete' END AS status FROM r JOIN (SELECT p, count(*) AS n, bool_or(contains(gaps, 'ambiguous_')) AS vague FROM r GROUP BY p) s ON s.p = r.p")
def property_trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = codebase.tables(spark, sf_dir)
    updates = framework.framework_relations(**base, tests=spark.createDataFrame([], "case_identity string, symbol_identity string"), **codebase.templates(spark)).where("relation = 'update_property' and diagnostic is null")
    p = F.col("p_partkey").cast("long")
    requests = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("trace"), F.concat(F.lit("entry:"), p).alias("seed"), F.concat(F.lit("method:"), p).alias("setter"), F.lit("comp0").alias("component"))
    components = spark.createDataFrame(COMPONENTS, "component string")
    found = property_trace.property_traces(requests, **base, updates=updates, templates=codebase.SETTERS, components=components)
    rows = found.paths.join(found.summary.select("trace", "status"), "trace")
    return rows.select("trace", F.array_join("path", ">").alias("path"), F.array_join("chain", ">").alias("chain"), F.array_join("gaps", ",").alias("gaps"), "status")


# --- creation traces

CREATION = f"""m AS (SELECT *, role IN ('pattern', 'model') AND comp = 'comp1' AS other, CASE WHEN v = 7 THEN 'view:2' WHEN v = 8 THEN 'view:3' WHEN v = 9 THEN 'view:1' ELSE 'view:0' END AS view FROM (SELECT *, CASE WHEN p % 9 = 0 THEN 'comp1' ELSE 'comp0' END AS comp FROM ({OWNED}) o) x),
    n AS (SELECT *, p % 5 = 4 AS direct, role = 'ambiguous' OR other OR v = 12 AS stopped, NOT other AND (role IN ('model', 'ambiguous') OR v <> 11) AS led,
    CASE v WHEN 1 THEN 'missing_definition' WHEN 10 THEN 'unsupported_pattern_callback' WHEN 2 THEN 'unsupported_pattern_argument' WHEN 4 THEN 'ambiguous_reference' WHEN 3 THEN 'missing_argument_reference' WHEN 5 THEN 'missing_allocation_call' WHEN 6 THEN 'ambiguous_allocation_call' WHEN 7 THEN 'unknown_pattern_role' WHEN 8 THEN 'ambiguous_role'
    ELSE CASE WHEN (v = 9) <> (comp = 'comp1') THEN 'different_component_or_role' END END AS arg FROM m),
    r AS (SELECT *, CASE WHEN NOT direct AND (p % 4 = 3 OR NOT led) THEN 0 WHEN stopped OR v = 11 THEN 1 ELSE 2 END AS far FROM n)"""


@query(
    f"""WITH {CREATION} SELECT p AS trace, concat(CASE WHEN direct THEN '' ELSE concat('start:', p, CASE WHEN far > 0 THEN '>' ELSE '' END) END, CASE WHEN direct OR far > 0 THEN concat('make:', p) ELSE '' END, CASE WHEN far = 2 THEN CASE WHEN v = 10 THEN '>frame:get' ELSE '>frame:create' END ELSE '' END) AS path,
    CASE WHEN far = 2 AND arg IS NULL THEN view END AS pattern, gaps, CASE WHEN contains(gaps, 'ambiguous_') THEN 'ambiguous' WHEN gaps = '' THEN 'complete' ELSE 'incomplete' END AS status FROM (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN far < 2 THEN 'missing_creation_relation' END, CASE WHEN far < 2 OR arg IS NOT NULL THEN 'missing_pattern_stage' END,
    CASE WHEN far = 2 THEN arg END, CASE WHEN far = 2 AND direct AND role = 'model' THEN 'missing_entry_stage' END, CASE WHEN far = 2 AND role <> 'model' THEN 'missing_model_stage' END, CASE WHEN far = 1 AND role = 'ambiguous' THEN 'ambiguous_role' END, CASE WHEN far = 1 AND other THEN 'different_component' END, CASE WHEN far = 1 AND v = 12 THEN 'missing_source_location' END], lambda x: x IS NOT NULL)), ',') AS gaps FROM r) z"""
)
def creation_trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = codebase.tables(spark, sf_dir)
    p = F.col("p_partkey").cast("long")
    requests = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("trace"), F.concat(F.when(p % 5 == 4, "make:").otherwise("start:"), p).alias("seed"), F.when(p % 9 == 0, "comp1").otherwise("comp0").alias("component"))
    frames = creation_trace.Frames(codebase.FRAME_CLASS, codebase.FRAME_FILE, ("CreateFrameNode",), ("GetOrCreateFrameNode",))
    found = creation_trace.creation_traces(requests, **base, components=spark.createDataFrame(COMPONENTS, "component string"), factories=codebase.templates(spark)["factories"], frames=frames, pattern=codebase.MAKING)
    rows = found.paths.join(found.summary.select("trace", "status"), "trace")
    return rows.select("trace", F.array_join("path", ">").alias("path"), "pattern", F.array_join("gaps", ",").alias("gaps"), "status")


# --- measure and layout traces

#: What is missing of each pane, by the numbers; the first eight end the trace.
LAYOUT = """CASE u WHEN 1 THEN ['missing_factory'] WHEN 2 THEN ['ambiguous_factory_identity'] WHEN 3 THEN ['missing_factory_definition'] WHEN 4 THEN ['unsupported_factory_body'] WHEN 5 THEN ['missing_algorithm_reference', 'missing_create_binding'] WHEN 6 THEN ['ambiguous_algorithm_identity', 'missing_create_binding']
    WHEN 7 THEN ['unknown_or_cross_component_algorithm'] WHEN 8 THEN ['missing_create_binding'] WHEN 9 THEN ['missing_measure_binding'] WHEN 10 THEN ['missing_layout_binding'] WHEN 11 THEN ['missing_measure_implementation'] WHEN 12 THEN [concat('unsupported_property_preamble:mea:', p)]
    WHEN 13 THEN CASE WHEN p % 5 = 4 THEN list_filter(['x'], lambda x: x = 'y') ELSE ['ambiguous_property_identity'] END WHEN 14 THEN ['missing_layout_property_dependency', 'unknown_or_cross_component_property'] ELSE list_filter(['x'], lambda x: x = 'y') END"""


@query(
    f"""SELECT p AS trace, CASE WHEN gaps LIKE 'ambiguous%' THEN 'ambiguous' WHEN gaps = '' THEN 'complete' ELSE 'incomplete' END AS status, gaps, CASE WHEN u IN (1) THEN 'pattern' WHEN u = 2 THEN 'factory,factory,pattern' WHEN u < 9 AND u > 2 THEN 'factory,pattern' ELSE concat('algorithm,factory,', CASE WHEN u <> 10 THEN 'layout,' ELSE '' END,
    CASE WHEN u <> 14 THEN 'layout_property,' ELSE '' END, CASE WHEN u NOT IN (9, 11) THEN 'measure,' ELSE '' END, 'pattern') END AS stages FROM (SELECT p_partkey AS p, p_size % 15 AS u, array_to_string({LAYOUT.replace("p % 5", "p_partkey % 5").replace("u WHEN 1 ", "p_size % 15 WHEN 1 ").replace("mea:', p)", "mea:', p_partkey)")}, ',') AS gaps FROM part) x"""
)
def layout_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("trace"), F.concat(F.lit("pane:"), "p_partkey").alias("seed"), F.lit("comp0").alias("component"))
    idioms = layout_trace_of.Idioms("CreateAlgorithm", codebase.FACTORY_BODY, codebase.ALLOCATION, codebase.PREAMBLE)
    found = layout_trace_of.layout_traces(requests, **codebase.panes(spark, sf_dir), idioms=idioms)
    stages = found.stages.groupBy("trace").agg(F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("stages"))
    return found.summary.join(stages, "trace").select("trace", "status", "gaps", "stages")
