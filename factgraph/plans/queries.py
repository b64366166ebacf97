"""One query for each operator over the projected facts, and independently written DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import identity, paths, ranges
from factgraph.operators import changes, expansion, graph, index, materialize, metrics, retrieval, rules, snippets, textsearch, traces
from factgraph.plans.projection import fact, oracle
from factgraph.sources import diffs, files, graphs, tests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *facts: str):
    """Register a query under its function's name, with the SQL over the named facts."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *facts)
        return f

    return add


def joined(column: str, sep: str = ","):
    return F.array_join(column, sep).alias(column)


# --- text search and files

LINES = "SELECT path, CAST(ordinality AS bigint) AS line, regexp_replace(l, '\\r+$', '') AS l FROM (SELECT path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS ordinality, len(string_split(content, chr(10))) AS n FROM files) WHERE NOT (ordinality = n AND l = '')"
HITS = "SELECT path, line AS start_line, CAST(p AS bigint) AS start_column, CAST(p + {n} AS bigint) AS end_column, substr(l, p, {n}) AS matched_text FROM (SELECT path, line, l, unnest(list_filter(range(1, length(l) + 1), lambda i: {test})) AS p FROM ({lines}) x)"


def hits(test: str, n: int) -> str:
    return HITS.format(n=n, test=test, lines=LINES)


@query(hits("substr(l, i, 3) = 'que'", 3), "files")
def text_literal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.search(fact(spark, sf_dir, "files"), textsearch.TextQuery("que")).select("path", "start_line", "start_column", "end_column", "matched_text")


@query(hits("lower(substr(l, i, 3)) = 'the'", 3) + " ORDER BY path, start_line, start_column LIMIT 200", "files")
def text_case_insensitive_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.search(fact(spark, sf_dir, "files"), textsearch.TextQuery("THE", case_sensitive=False, limit=200)).select("path", "start_line", "start_column", "end_column", "matched_text")


@query(hits("substr(l, i, 4) = 'ment'", 4) + " WHERE path LIKE 'doc/fr/%' AND (path LIKE '%0.txt' OR path LIKE '%5.txt')", "files")
def text_glob_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.search(fact(spark, sf_dir, "files"), textsearch.TextQuery("ment", scope="doc/fr", globs=("fr/*0.txt", "*5.txt"))).select("path", "start_line", "start_column", "end_column", "matched_text")


@query(f"SELECT path, line AS start_line, m AS matched_text, count(*) AS n FROM (SELECT path, line, unnest(regexp_extract_all(l, 'qu[ae][a-z]+')) AS m FROM ({LINES}) x) GROUP BY ALL", "files")
def text_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.search(fact(spark, sf_dir, "files"), textsearch.TextQuery("qu[ae][a-z]+", regex=True)).groupBy("path", "start_line", "matched_text").agg(F.count("*").alias("n"))


@query(
    """SELECT path, CASE WHEN NOT regexp_matches(lower(path), '[.](c|cc|cpp|cxx|m|mm|h|hh|hpp|hxx|inc)$') THEN 'other' WHEN regexp_matches(lower(path), '(^|/)tests?/|(^|/)test_[^/]*$|_(unit)?test[.][a-z]+$') THEN 'test'
    WHEN regexp_matches(lower(path), '[.](h|hh|hpp|hxx|inc)$') THEN 'header' ELSE 'source' END AS type, CASE WHEN path LIKE 'build/%' THEN 'build' WHEN path LIKE 'lib/Out/%' THEN 'Out' END AS excluded FROM paths""",
    "paths",
)
def file_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir, "paths").select("path", paths.file_type("path").alias("type"), paths.excluded_directory("path").alias("excluded"))


@query("SELECT path FROM paths WHERE path NOT LIKE 'build/%' AND path NOT LIKE 'lib/Out/%' AND path LIKE '%test%' AND NOT path LIKE '%1%' AND regexp_matches(lower(path), '[.](cc|cpp|h|hpp)$')", "paths")
def file_scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filtered(fact(spark, sf_dir, "paths"), include=["*test*"], exclude=["*1*"], types=["test", "source", "header"])


@query("SELECT path, sha256(content) AS sha256 FROM files", "files")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inventory(fact(spark, sf_dir, "files"))


@query(
    """SELECT path, count(*) AS lines, max(o) AS last_offset, max(CASE WHEN line = 2 THEN o + 2 END) AS second_line_column_3 FROM (SELECT path, line, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS o
    FROM (SELECT path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files) x) y GROUP BY path""",
    "files",
)
def line_col_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snippets.line_offsets(fact(spark, sf_dir, "files"))
    return found.groupBy("path").agg(F.count("*").alias("lines"), F.max("offset").alias("last_offset"), F.max(F.when(F.col("line") == 2, F.col("offset") + 2)).alias("second_line_column_3"))


@query(
    """SELECT path, CAST(1 + length(h) - length(replace(h, chr(10), '')) AS bigint) AS line, CAST(length(h) - coalesce(length(h) - position(chr(10) IN reverse(h)) + 1, 0) * CAST(contains(h, chr(10)) AS bigint) + 1 AS bigint) AS "column"
    FROM (SELECT path, left(content, CAST(length(content) // 2 AS bigint)) AS h FROM files) x""",
    "files",
)
def offset_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("content") / 2)
    return fact(spark, sf_dir, "files").select("path", ranges.offset_line(F.col("content"), half).cast("long").alias("line"), ranges.offset_column(F.col("content"), half).cast("long").alias("column"))


@query(
    """SELECT p_partkey, concat('test-entity:', sha256(concat('case', chr(0), p_brand, chr(0), p_name, chr(0), p_size))) AS test_identity, upper(substr(sha1(p_name), 1, 16)) AS usr_id,
    concat('graph-node:v1:["', p_type, '","', p_name, '"]') AS node_value, p_name AS tail FROM part"""
)
def stable_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = F.col
    return rows.select("p_partkey", identity.test_identity("case", c("p_brand"), c("p_name"), c("p_size")).alias("test_identity"), identity.usr_id(c("p_name")).alias("usr_id"), identity.node_value(c("p_type"), c("p_name")).alias("node_value"), identity.unqualified(F.concat_ws("::", "p_brand", "p_name")).alias("tail"))


# --- index lookups and joins

SYMBOL = "identity, kind, display_name, qualified_name"


def least(spark: SparkSession, sf_dir: str, name: str, column) -> str:
    return fact(spark, sf_dir, name).where("kind = 'function'").agg(F.min(column)).first()[0]


@query(f"SELECT {SYMBOL} FROM symbols WHERE display_name = (SELECT min(p_name) FROM part)", "symbols")
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.by_name(fact(spark, sf_dir, "symbols"), least(spark, sf_dir, "symbols", "display_name")).select(*SYMBOL.split(", "))


@query(f"SELECT {SYMBOL} FROM symbols WHERE qualified_name = (SELECT min(p_brand || '::' || p_name) FROM part)", "symbols")
def symbols_by_qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.by_qualified_name(fact(spark, sf_dir, "symbols"), least(spark, sf_dir, "symbols", "qualified_name")).select(*SYMBOL.split(", "))


@query(
    """SELECT s.identity, s.kind, d.start_line AS declared, d.end_line AS declared_end, f.start_line AS defined, f.end_line AS defined_end, coalesce(d.file_path, f.file_path) AS file_path FROM symbols s
    LEFT JOIN (SELECT * FROM symbol_ranges WHERE role = 'declaration') d ON d.symbol_identity = s.identity LEFT JOIN (SELECT * FROM symbol_ranges WHERE role = 'definition') f ON f.symbol_identity = s.identity""",
    "symbols", "symbol_ranges",
)
def symbol_get_with_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.with_ranges(fact(spark, sf_dir, "symbols"), fact(spark, sf_dir, "symbol_ranges"))
    return found.select("identity", "kind", F.col("declaration.start_line").alias("declared"), F.col("declaration.end_line").alias("declared_end"), F.col("definition.start_line").alias("defined"), F.col("definition.end_line").alias("defined_end"), F.coalesce("declaration.file_path", "definition.file_path").alias("file_path"))


@query(f"SELECT DISTINCT {SYMBOL} FROM symbols JOIN symbol_ranges ON identity = symbol_identity WHERE file_path = (SELECT 'src/' || min(p_brand) || '.cpp' FROM part)", "symbols", "symbol_ranges")
def symbols_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.concat(F.lit("src/"), F.min("p_brand"), F.lit(".cpp"))).first()[0]
    return index.in_file(fact(spark, sf_dir, "symbols"), fact(spark, sf_dir, "symbol_ranges"), path).select(*SYMBOL.split(", "))


@query("SELECT DISTINCT path FROM (SELECT file_path AS path FROM symbol_ranges UNION ALL SELECT file_path FROM symbol_references UNION ALL SELECT file_path FROM test_entities)", "symbol_ranges", "symbol_references", "test_entities")
def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.all_files(*(fact(spark, sf_dir, t) for t in ("symbol_ranges", "symbol_references", "test_entities")))


@query("SELECT DISTINCT file_path, start_line, end_column FROM symbol_references WHERE symbol_identity = 'part:1'", "symbol_references")
def semantic_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.references_of(fact(spark, sf_dir, "symbol_references"), "part:1").select("file_path", "start_line", "end_column")


def calls_sql(caller: str, callee: str, kind: str) -> str:
    return f"""SELECT r.{caller} AS caller, r.{callee} AS callee, a.identity IS NOT NULL AS caller_known, b.identity IS NOT NULL AS callee_known, coalesce(f.file_path, d.file_path) AS file_path, coalesce(f.start_line, d.start_line) AS start_line
    FROM symbol_relations r LEFT JOIN symbols a ON a.identity = r.{caller} LEFT JOIN symbols b ON b.identity = r.{callee}
    LEFT JOIN symbol_ranges f ON f.symbol_identity = r.{caller} AND f.role = 'definition' LEFT JOIN symbol_ranges d ON d.symbol_identity = r.{caller} AND d.role = 'declaration' WHERE relation_kind = '{kind}'"""


def calls(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = index.calls(*(fact(spark, sf_dir, t) for t in ("symbol_relations", "symbols", "symbol_ranges")), kind)
    return found.select("caller", "callee", "caller_known", "callee_known", "file_path", "start_line")


@query(calls_sql("source_identity", "target_identity", "callee"), "symbol_relations", "symbols", "symbol_ranges")
def direct_calls_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir, "callee")


@query(calls_sql("target_identity", "source_identity", "caller"), "symbol_relations", "symbols", "symbol_ranges")
def direct_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir, "caller")


CASES = """SELECT e.identity, e.display_name, c.fixture_identity, e.start_line, b.end_line AS body_end_line FROM test_entities e, test_fixture_cases c, test_case_bodies b
    WHERE e.kind = 'case' AND c.case_identity = e.identity AND b.case_identity = e.identity"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.test_cases(*(fact(spark, sf_dir, t) for t in ("test_entities", "test_fixture_cases", "test_case_bodies"))).select("identity", "display_name", "fixture_identity", "start_line", "body_end_line")


@query(CASES, "test_entities", "test_fixture_cases", "test_case_bodies")
def test_cases_with_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir)


@query(CASES + " AND c.fixture_identity = 'fixture:1'", "test_entities", "test_fixture_cases", "test_case_bodies")
def test_cases_for_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).where("fixture_identity = 'fixture:1'")


@query(CASES + " AND e.display_name = 'case7'", "test_entities", "test_fixture_cases", "test_case_bodies")
def test_cases_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).where("display_name = 'case7'")


@query("SELECT DISTINCT e.identity, e.display_name, e.file_path, (SELECT count(*) FROM test_fixture_cases c WHERE c.fixture_identity = e.identity) AS cases FROM test_entities e WHERE kind = 'fixture'", "test_entities", "test_fixture_cases")
def test_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fact(spark, sf_dir, "test_fixture_cases").groupBy(F.col("fixture_identity").alias("identity")).agg(F.count("*").alias("cases"))
    return fact(spark, sf_dir, "test_entities").where("kind = 'fixture'").join(n, "identity", "left").select("identity", "display_name", "file_path", F.coalesce("cases", F.lit(0)).alias("cases"))


#: a reference lies in the body of its nearest preceding case
NEAREST = """SELECT r.symbol_identity, r.file_path, r.start_line, (SELECT b.case_identity FROM test_case_bodies b WHERE b.file_path = r.file_path AND b.start_line <= r.start_line ORDER BY b.start_line DESC LIMIT 1) AS case_identity FROM event_references r"""


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.contained_references(fact(spark, sf_dir, "event_references"), fact(spark, sf_dir, "test_case_bodies"))


@query(f"SELECT * FROM ({NEAREST}) WHERE case_identity IS NOT NULL AND start_line < (SELECT end_line FROM test_case_bodies b WHERE b.case_identity = x.case_identity)".replace(f"({NEAREST})", f"({NEAREST}) x"), "event_references", "test_case_bodies")
def containment_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir).select("symbol_identity", "file_path", "start_line", "case_identity")


@query(f"SELECT case_identity, symbol_identity, count(*) AS refs, min(start_line) AS first_line, max(start_line) AS last_line FROM ({NEAREST}) x WHERE case_identity IS NOT NULL GROUP BY ALL", "event_references", "test_case_bodies")
def tested_symbol_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.tested_symbols(contained(spark, sf_dir))
    return found.select("case_identity", "symbol_identity", F.size("references").cast("long").alias("refs"), F.col("references")[0]["start_line"].alias("first_line"), F.element_at("references", -1)["start_line"].alias("last_line"))


@query(f"SELECT case_identity, count(DISTINCT symbol_identity) AS symbols FROM ({NEAREST}) x WHERE case_identity IS NOT NULL GROUP BY case_identity", "event_references", "test_case_bodies")
def symbols_referenced_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.referenced_symbols(contained(spark, sf_dir)).groupBy("case_identity").agg(F.count("*").alias("symbols"))


@query(f"SELECT DISTINCT case_identity FROM ({NEAREST}) x WHERE case_identity IS NOT NULL AND symbol_identity = 'type:error'", "event_references", "test_case_bodies")
def cases_for_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir).where("symbol_identity = 'type:error'").select("case_identity").distinct()


@query("SELECT c.event_id, (SELECT max(v.line) FROM event_lines v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND v.line < c.line) AS declared_line FROM event_lines c WHERE c.event_type = 'purchase'", "event_lines")
def preceding_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest view before each purchase: one ordered pass over a user's lines instead of a range join."""
    rows = index.nearest_before(fact(spark, sf_dir, "event_lines"), ["user_id"], "line", F.col("event_type") == "view", "declared_line")
    return rows.where("event_type = 'purchase'").select("event_id", "declared_line")


@query("SELECT source_identity, relation_kind, target_identity FROM symbol_relations WHERE target_identity NOT IN (SELECT identity FROM symbols)", "symbol_relations", "symbols")
def dangling_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dangling(fact(spark, sf_dir, "symbol_relations"), "target_identity", fact(spark, sf_dir, "symbols"), "identity").select("source_identity", "relation_kind", "target_identity")


@query("SELECT concat(l_orderkey, '/', l_linenumber) AS id, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), "l_partkey", "l_suppkey")
    return index.conflicting(rows, "id")


@query(
    """SELECT concat('part:', p_partkey) AS identity, CASE WHEN p_partkey % 13 = 0 THEN 'kind' WHEN p_partkey % 11 = 0 THEN 'declaration_site_containment' WHEN p_partkey % 35 = 0 THEN 'parent_identity' END AS conflict,
    10 * p_partkey + 1 AS declared, CASE WHEN p_size % 2 = 0 THEN 10 * p_partkey + 2 END AS defined, CASE WHEN p_partkey % 35 = 0 AND p_partkey % 11 > 0 THEN NULL WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'p1' WHEN p_partkey % 5 = 0 THEN 'p2' END AS parent_identity FROM part"""
)
def canonical_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")

    def place(shift: int):
        line = 10 * F.col("p_partkey") + shift
        return F.struct(F.concat(F.lit("src/"), "p_brand").alias("file_path"), line.alias("start_line"), F.lit(1).alias("start_column"), (line + 5).alias("end_line"), F.lit(1).alias("end_column"))

    def seen(kind, display, parent, declaration, definition) -> DataFrame:
        none = F.lit(None).cast(p.select(place(1)).schema[0].dataType)
        return p.select(F.concat(F.lit("part:"), "p_partkey").alias("identity"), kind.alias("kind"), display.alias("display_name"), F.col("p_name").alias("qualified_name"), parent.cast("string").alias("parent_identity"), F.lit(None).cast("string").alias("namespace_identity"), (declaration if declaration is not None else none).alias("declaration"), (definition if definition is not None else none).alias("definition"), none.alias("site"), F.lit(None).cast("string").alias("parent_kind"))

    key, plain = F.col("p_partkey"), F.lit("function")
    rows = seen(plain, F.col("p_name"), F.when(key % 5 == 0, "p2"), place(1), None)
    rows = rows.union(seen(plain, F.when(key % 11 == 0, F.concat(F.lit("x"), "p_name")).otherwise(F.col("p_name")), F.when(key % 7 == 0, "p1"), None, F.when(F.col("p_size") % 2 == 0, place(2))))
    rows = rows.union(seen(F.when(key % 13 == 0, "method").otherwise(plain), F.col("p_name"), F.lit(None), place(1), None))
    return index.canonical(rows).select("identity", "conflict", F.col("declaration.start_line").alias("declared"), F.col("definition.start_line").alias("defined"), "parent_identity")


@query("SELECT source_identity AS identity, relation_kind AS kind, count(DISTINCT target_identity) AS n, min(target_identity) AS first_item, max(target_identity) AS last_item FROM symbol_relations GROUP BY ALL", "symbol_relations")
def merge_semantic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact(spark, sf_dir, "symbol_relations").select(F.col("source_identity").alias("identity"), F.col("relation_kind").alias("kind"), F.col("target_identity").alias("item"))
    return index.merge_facts(rows).select("identity", "kind", F.size("items").cast("long").alias("n"), F.col("items")[0].alias("first_item"), F.element_at("items", -1).alias("last_item"))


@query("SELECT r.symbol_identity, r.file_path, r.start_line, count(*) AS matches FROM symbol_references r JOIN (SELECT DISTINCT concat('order/', l_orderkey) AS f, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R') e ON e.f = r.file_path AND e.n = r.start_line GROUP BY ALL", "symbol_references")
def exact_range_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose whole range equals an evidence's range."""
    evidence = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.concat(F.lit("order/"), "l_orderkey").alias("file_path"), F.col("l_linenumber").cast("long").alias("start_line"), F.lit(1).cast("long").alias("start_column"), F.col("l_linenumber").cast("long").alias("end_line"), F.lit(5).cast("long").alias("end_column")).distinct()
    return index.at_exact_range(fact(spark, sf_dir, "symbol_references"), evidence).groupBy("symbol_identity", "file_path", "start_line").agg(F.count("*").alias("matches"))


# --- graph

EDGE = "src_key, dst_key, relation"


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir, "symbols").select(F.lit("symbol").alias("namespace"), F.col("identity").alias("key"), "kind", "display_name")


@query("SELECT concat('order:', l_orderkey) AS src_key, concat('part:', l_partkey) AS dst_key, count(DISTINCT l_linenumber) AS evidence, CAST(min(l_linenumber) AS bigint) AS first_line FROM lineitem GROUP BY ALL")
def edge_evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("order").alias("src_ns"), F.concat(F.lit("order:"), "l_orderkey").alias("src_key"), F.lit("symbol").alias("dst_ns"), F.concat(F.lit("part:"), "l_partkey").alias("dst_key"), F.lit("reference").alias("relation"), F.lit("line").alias("provenance"), F.col("l_linenumber").cast("long").alias("start_line"))
    return graph.merge_evidence(rows).select("src_key", "dst_key", F.size("evidence").cast("long").alias("evidence"), F.col("evidence")[0]["start_line"].alias("first_line"))


@query("SELECT src_key, dst_key, relation, 'dst' AS missing FROM edges WHERE relation = 'call' AND dst_key NOT IN (SELECT concat('part:', p_partkey) FROM part WHERE p_size > 1)", "edges")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size = 1").select(F.concat(F.lit("part:"), "p_partkey").alias("key"))
    return graph.dangling_edges(nodes_of(spark, sf_dir).join(part, "key", "left_anti"), fact(spark, sf_dir, "edges")).select("src_key", "dst_key", "relation", "missing")


TESTED = f"(SELECT case_identity, symbol_identity, file_path, start_line FROM ({NEAREST}) x WHERE case_identity IS NOT NULL AND start_line < (SELECT end_line FROM test_case_bodies b WHERE b.case_identity = x.case_identity)) t"
PROJECTION = f"""SELECT 'edge' AS what, relation AS kind, count(*) AS n FROM (SELECT DISTINCT 'define' AS relation, file_path, symbol_identity, start_line, start_column, end_line, end_column FROM symbol_ranges WHERE role = 'definition'
    UNION ALL SELECT DISTINCT 'declare', file_path, symbol_identity, start_line, start_column, end_line, end_column FROM symbol_ranges WHERE role = 'declaration' UNION ALL SELECT 'reference', file_path, symbol_identity, start_line, start_column, end_line, end_column FROM symbol_references
    UNION ALL SELECT 'call', source_identity, target_identity, 0, 0, 0, 0 FROM symbol_relations UNION ALL SELECT 'test', fixture_identity, case_identity, 0, 0, 0, 0 FROM test_fixture_cases
    UNION ALL SELECT DISTINCT 'test', case_identity, symbol_identity, start_line, hash(file_path), 0, 0 FROM {TESTED}) GROUP BY relation
    UNION ALL SELECT 'node', kind, count(*) FROM (SELECT CASE kind WHEN 'function' THEN 'function' WHEN 'class' THEN 'class' WHEN 'struct' THEN 'class' ELSE 'symbol' END AS kind, identity FROM symbols UNION SELECT 'test_' || kind, identity FROM test_entities
    UNION SELECT 'symbol', target_identity FROM symbol_relations WHERE target_identity NOT IN (SELECT identity FROM symbols) UNION SELECT 'symbol', source_identity FROM symbol_relations WHERE source_identity NOT IN (SELECT identity FROM symbols) UNION SELECT 'symbol', symbol_identity FROM {TESTED}
    UNION SELECT 'file', file_path FROM symbol_ranges UNION SELECT 'file', file_path FROM symbol_references) GROUP BY kind"""


@query(PROJECTION, "symbols", "symbol_ranges", "symbol_references", "symbol_relations", "test_entities", "test_fixture_cases", "event_references", "test_case_bodies")
def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [fact(spark, sf_dir, t) for t in ("symbols", "symbol_ranges", "symbol_references", "symbol_relations", "test_entities", "test_fixture_cases")]
    nodes, evidence = graph.project(*tables, contained(spark, sf_dir))
    return evidence.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n").union(nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n"))


@query(f"SELECT 'in' AS side, {EDGE} FROM edges WHERE dst_key = 'nation:3' UNION ALL SELECT 'out', {EDGE} FROM edges WHERE src_key = 'nation:3' AND relation = 'define'", "edges")
def graph_in_out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pick = fact(spark, sf_dir, "edges"), EDGE.split(", ")
    return graph.incoming(edges, "symbol", "nation:3").select(F.lit("in").alias("side"), *pick).union(graph.outgoing(edges, "symbol", "nation:3", ["define"]).select(F.lit("out").alias("side"), *pick))


@query("SELECT DISTINCT identity AS key, kind FROM symbols WHERE identity IN (SELECT dst_key FROM edges WHERE src_key = 'supplier:1' UNION SELECT src_key FROM edges WHERE dst_key = 'supplier:1')", "symbols", "edges")
def graph_neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(nodes_of(spark, sf_dir), fact(spark, sf_dir, "edges"), "symbol", "supplier:1").select("key", "kind")


@query("WITH RECURSIVE w(key, depth) AS (SELECT 'region:0', 0 UNION SELECT e.dst_key, w.depth + 1 FROM w JOIN edges e ON e.src_key = w.key WHERE w.depth < 2) SELECT key, CAST(min(depth) AS bigint) AS depth FROM w GROUP BY key", "edges")
def graph_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.traverse(nodes_of(spark, sf_dir), fact(spark, sf_dir, "edges"), "symbol", "region:0", 2, max_nodes=None, max_edges=None)
    return found.visits.select("key", F.col("depth").cast("long").alias("depth"))


@query("SELECT CAST(row_number() OVER (ORDER BY d, p, key) - 1 AS bigint) AS rank, key FROM (SELECT 0 AS d, '' AS p, 'region:0' AS key UNION ALL SELECT 1, '', dst_key FROM edges WHERE src_key = 'region:0' UNION ALL SELECT 2, a.dst_key, b.dst_key FROM edges a JOIN edges b ON b.src_key = a.dst_key WHERE a.src_key = 'region:0') ORDER BY 1 LIMIT 12", "edges")
def graph_bfs_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(nodes_of(spark, sf_dir), fact(spark, sf_dir, "edges"), "symbol", "region:0", 3, 12, 1000).visits.select("rank", "key")


@query("WITH RECURSIVE w(key) AS (SELECT 'part:3' UNION SELECT e.src_key FROM w JOIN edges e ON e.dst_key = w.key) SELECT key FROM w", "edges")
def reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.range(1).select(F.lit("symbol").alias("namespace"), F.lit("part:3").alias("key"))
    return graph.reaching(fact(spark, sf_dir, "edges"), target).select("key")


@query("SELECT concat_ws('>', a.src_key, a.dst_key, b.dst_key) AS path, 2 AS length FROM edges a LEFT JOIN edges b ON b.src_key = a.dst_key WHERE a.src_key = 'region:1'".replace("2 AS length", "CAST(CASE WHEN b.dst_key IS NULL THEN 1 ELSE 2 END AS bigint) AS length"), "edges")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.simple_paths(fact(spark, sf_dir, "edges"), "symbol", "region:1", 2, 1_000_000, 1_000_000)
    return found.paths.select(F.array_join(F.transform("path", lambda n: n["key"]), ">").alias("path"), F.col("length").cast("long").alias("length"))


ROLE = """SELECT s.identity, CASE WHEN s.kind <> 'class' THEN 'unsupported_symbol_kind' WHEN s.identity NOT LIKE 'nation:%' OR NOT EXISTS (SELECT 1 FROM rules r WHERE r.qualified_name = s.qualified_name) THEN 'no_qualified_name_rule'
    WHEN NOT EXISTS (SELECT 1 FROM rules r JOIN symbol_ranges g ON g.file_path = r.file_path WHERE r.qualified_name = s.qualified_name AND g.symbol_identity = s.identity) THEN 'source_file_mismatch'
    WHEN (SELECT count(DISTINCT (r.role, coalesce(r.component, ''))) FROM rules r JOIN symbol_ranges g ON g.file_path = r.file_path WHERE r.qualified_name = s.qualified_name AND g.symbol_identity = s.identity) = 1 THEN 'exact_catalog_match' ELSE 'conflicting_role_or_component_rules' END AS reason FROM symbols s"""


@query(f"SELECT identity, reason, CASE reason WHEN 'exact_catalog_match' THEN 'recognized' WHEN 'conflicting_role_or_component_rules' THEN 'ambiguous' ELSE 'unknown' END AS status FROM ({ROLE}) x", "symbols", "symbol_ranges", "rules")
def role_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping(spark, sf_dir).select("identity", "reason", "status")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return rules.role_mapping(nodes, fact(spark, sf_dir, "symbols"), fact(spark, sf_dir, "symbol_ranges"), fact(spark, sf_dir, "rules"))


@query(f"SELECT r.component, count(DISTINCT x.identity) AS members, min(x.identity) AS first_member FROM ({ROLE}) x JOIN symbols s ON s.identity = x.identity JOIN rules r ON r.qualified_name = s.qualified_name JOIN symbol_ranges g ON g.symbol_identity = s.identity AND g.file_path = r.file_path WHERE x.reason = 'exact_catalog_match' AND r.component IS NOT NULL GROUP BY r.component", "symbols", "symbol_ranges", "rules")
def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.component_members(mapping(spark, sf_dir))


@query(
    """SELECT src_key, dst_key, count(*) AS proofs, CASE WHEN count(*) = count(*) FILTER (given) THEN 'verified' ELSE 'broken' END AS state FROM (SELECT concat('supplier:', l_suppkey) AS src_key, concat('part:', l_partkey) AS dst_key, l_linenumber, bool_or(l_returnflag <> 'R') AS given FROM lineitem GROUP BY ALL) GROUP BY src_key, dst_key"""
)
def edge_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("symbol").alias("src_ns"), F.concat(F.lit("supplier:"), "l_suppkey").alias("src_key"), F.lit("symbol").alias("dst_ns"), F.concat(F.lit("part:"), "l_partkey").alias("dst_key"), F.lit("call").alias("relation"), "l_linenumber", "l_returnflag")
    return traces.verified_edges(rows.where("l_returnflag <> 'R'").drop("l_returnflag"), rows.drop("l_returnflag")).select("src_key", "dst_key", "proofs", "state")


@query(
    f"""SELECT s.identity, s.parent_identity AS owner, m.role, m.component FROM symbols s LEFT JOIN (SELECT DISTINCT x.identity, r.role, coalesce(r.component, '') AS component FROM ({ROLE}) x JOIN symbols c ON c.identity = x.identity JOIN rules r ON r.qualified_name = c.qualified_name
    JOIN symbol_ranges g ON g.symbol_identity = c.identity AND g.file_path = r.file_path WHERE x.reason = 'exact_catalog_match') m ON m.identity = s.parent_identity""",
    "symbols", "symbol_ranges", "rules",
)
def owner_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.owner_roles(fact(spark, sf_dir, "symbols"), mapping(spark, sf_dir))


@query("SELECT DISTINCT key FROM (SELECT src_key AS key FROM edges UNION ALL SELECT dst_key FROM edges WHERE src_key IN ('region:0', 'region:2')) WHERE key IN ('region:0', 'region:2') OR key LIKE 'nation:%' AND key IN (SELECT dst_key FROM edges WHERE src_key IN ('region:0', 'region:2'))", "edges")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("symbol", "region:2"), ("symbol", "region:0"), ("symbol", "region:2")], "namespace string, key string")
    return expansion.expand(nodes_of(spark, sf_dir), fact(spark, sf_dir, "edges"), seeds, expansion.Policy(depth=1)).nodes.select("key")


@query("SELECT concat_ws('>', a.src_key, a.dst_key, b.dst_key) AS path, '' AS gaps FROM edges a JOIN edges b ON b.src_key = a.dst_key WHERE a.src_key = (SELECT concat('region:', min(n_regionkey)) FROM nation JOIN supplier ON s_nationkey = n_nationkey) AND b.dst_key LIKE 'supplier:%'", "edges")
def staged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths region > nation > supplier, of the first region that has a supplier."""
    edges = fact(spark, sf_dir, "edges")
    stage = F.substring_index("key", ":", 1)
    stages = nodes_of(spark, sf_dir).select("namespace", "key", stage.alias("stage")).where("stage in ('region', 'nation', 'supplier')")
    seed = edges.where("dst_key like 'nation:%'").join(edges.where("dst_key like 'supplier:%'").select(F.col("src_key").alias("dst_key")), "dst_key", "left_semi").agg(F.min("src_key")).first()[0]
    found = traces.staged_trace(edges, stages, ("symbol", seed), ["region", "nation", "supplier"], max_paths=1_000_000, max_states=1_000_000)
    return found.paths.select(F.array_join("path", ">").alias("path"), joined("gaps"))


@query("SELECT * FROM nation")
def graph_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return graphs.decoded(graphs.encoded(rows), ", ".join(f"{n} {t}" for n, t in rows.dtypes))


# --- retrieval

HINTS = """SELECT CAST(n_nationkey AS bigint) AS task_id, 1 AS ordinal, 'component' AS kind, n_name AS value, true AS valid FROM nation UNION ALL SELECT n_nationkey, 2, 'symbol', r_name || '::' || n_name, true FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_nationkey, 3, 'action', '', false FROM nation WHERE n_nationkey % 2 = 0"""


@query(f"SELECT task_id, CAST(ordinal AS bigint) AS ordinal, kind, value, valid FROM ({HINTS}) x")
def task_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hints(fact(spark, sf_dir, "tasks"))


@query(
    f"""SELECT task_id, channel, selector, qualified, string_agg(origin, ',' ORDER BY origin) AS origins FROM (SELECT task_id, 'text' AS channel, text AS selector, false AS qualified, 'line:000001' AS origin FROM tasks
    UNION ALL SELECT task_id, 'text', value, false, 'hint:00000' || ordinal FROM ({HINTS}) h WHERE valid UNION ALL SELECT task_id, c, value, value LIKE '%::%', 'hint:00000' || ordinal FROM ({HINTS}) h, unnest(['symbol','declaration','definition','reference','callers','callees','tests_for_symbol']) AS t(c) WHERE valid
    UNION ALL SELECT task_id, 'domain_component', value, false, 'hint:00000' || ordinal FROM ({HINTS}) h WHERE kind = 'component') GROUP BY ALL""",
    "tasks",
)
def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = fact(spark, sf_dir, "tasks")
    return retrieval.plan_queries(tasks, retrieval.hints(tasks)).select("task_id", "channel", "selector", "qualified", joined("origins"))


@query("SELECT channel, CASE WHEN channel IN ('inherit', 'mock') THEN 'unsupported' WHEN length(selector) > 40 THEN 'truncated' WHEN contains(selector, chr(10)) THEN 'unsupported' END AS refusal, count(*) AS n FROM (SELECT ['text', 'symbol', 'inherit', 'mock'][1 + doc_id % 4] AS channel, left(content, CAST(doc_id % 80 AS bigint)) AS selector FROM files) GROUP BY ALL", "files")
def selector_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact(spark, sf_dir, "files").select(F.element_at(F.array(*map(F.lit, ("text", "symbol", "inherit", "mock"))), (1 + F.col("doc_id") % 4).cast("int")).alias("channel"), F.expr("left(content, cast(doc_id % 80 as int))").alias("selector"))
    return retrieval.guarded(rows, retrieval.Bounds(query_chars=40)).groupBy("channel", "refusal").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, total, total > 5 AS truncated FROM (SELECT p_brand, p_partkey, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand) AS total, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND (b.p_size > a.p_size OR b.p_size = a.p_size AND b.p_partkey < a.p_partkey)) AS better FROM part a) WHERE better < 5")
def channel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", (-F.col("p_size")).alias("order"))
    return retrieval.first_n(rows, ["p_brand"], ["order", "p_partkey"], 5).select("p_brand", "p_partkey", "total", "truncated")


@query("SELECT q.query_id, count(*) AS candidates, max(q.n) > 1 AS ambiguous, max(q.n) > 20 AS truncated FROM (SELECT 'q:' || p_name AS query_id, identity, row_number() OVER (PARTITION BY p_name ORDER BY identity) AS i, count(*) OVER (PARTITION BY p_name) AS n FROM (SELECT DISTINCT p_name FROM part) p JOIN symbols s ON s.display_name = p.p_name) q WHERE q.i <= 20 GROUP BY q.query_id", "symbols")
def symbol_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("q:"), "p_name").alias("query_id"), F.lit("symbol").alias("channel"), F.col("p_name").alias("selector"), F.lit(False).alias("qualified")).distinct()
    return retrieval.symbol_channel(names, fact(spark, sf_dir, "symbols"), retrieval.Bounds()).groupBy("query_id").agg(F.count("*").alias("candidates"), F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("truncated").alias("truncated"))


@query("SELECT CAST(l_partkey AS varchar) AS fact_key, string_agg(DISTINCT CAST(l_suppkey % 7 AS varchar), ',' ORDER BY CAST(l_suppkey % 7 AS varchar)) AS queries, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS channels, bool_or(l_tax > 0.07) AS ambiguous, bool_or(l_discount = 0) AS unresolved FROM lineitem GROUP BY l_partkey")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("symbol").alias("fact_type"), F.col("l_partkey").cast("string").alias("fact_key"), (F.col("l_suppkey") % 7).cast("string").alias("query_id"), F.col("l_returnflag").alias("channel"), (F.col("l_tax") > 0.07).alias("ambiguous"), (F.col("l_discount") == 0).alias("unresolved"))
    return retrieval.merged(rows).select("fact_key", joined("queries"), joined("channels"), "ambiguous", "unresolved")


@query("SELECT 'kept' AS what, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey % 50 <> 0)) UNION ALL SELECT 'unresolved', count(*) FROM (SELECT l_orderkey % 100 AS q FROM lineitem WHERE l_partkey % 50 = 0 GROUP BY 1)")
def fingerprint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") % 100).alias("query_id"), F.col("l_orderkey").alias("fact_key")).agg(F.collect_set(F.concat(F.lit("p/"), "l_partkey")).alias("paths"))
    bound = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 50 <> 0").select(F.concat(F.lit("p/"), "p_partkey").alias("path"))
    kept, lost = retrieval.within_fingerprint(facts, bound)
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n").union(lost.agg(F.count("*").alias("n")).select(F.lit("unresolved").alias("what"), "n"))


# --- changes

BLOCKS = """SELECT l_orderkey, isl, min(old_line) AS old_start, min(old_line) + count(*) FILTER (kind = 'delete') AS old_end, min(new_line) AS new_start, min(new_line) + count(*) FILTER (kind = 'add') AS new_end FROM (SELECT a.l_orderkey, a.kind, (SELECT count(*) FROM diff_lines b WHERE b.l_orderkey = a.l_orderkey AND b.seq < a.seq AND b.kind = 'context') AS isl,
    1 + (SELECT count(*) FROM diff_lines b WHERE b.l_orderkey = a.l_orderkey AND b.seq < a.seq AND b.kind IN ('context', 'delete')) AS old_line, 1 + (SELECT count(*) FROM diff_lines b WHERE b.l_orderkey = a.l_orderkey AND b.seq < a.seq AND b.kind IN ('context', 'add')) AS new_line FROM diff_lines a) WHERE kind <> 'context' GROUP BY l_orderkey, isl"""


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY isl) AS block, old_start, old_end, new_start, new_end FROM ({BLOCKS}) x", "diff_lines")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_blocks(fact(spark, sf_dir, "diff_lines"), ["l_orderkey"])


MATCHES = """SELECT DISTINCT anchor_id, symbol_identity, role, CASE WHEN a.start_line = a.end_line THEN 'point_interior' WHEN r.start_line <= a.start_line AND a.end_line <= r.end_line THEN 'enclosing' ELSE 'intersecting' END AS relation FROM anchors a JOIN symbol_ranges r ON a.file_path = r.file_path
    WHERE a.start_line IS NOT NULL AND r.start_line < r.end_line AND CASE WHEN a.start_line = a.end_line THEN r.start_line < a.start_line AND a.start_line < r.end_line ELSE greatest(a.start_line, r.start_line) < least(a.end_line, r.end_line) END"""


@query(MATCHES, "anchors", "symbol_ranges")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.mapped_symbols(fact(spark, sf_dir, "anchors"), fact(spark, sf_dir, "symbol_ranges"))


MAPPED_FILES = """SELECT concat('src/', b, '.cpp') AS path, n % 11 <> 3 AS in_scope, n % 11 <> 4 AS fingerprinted, n % 11 <> 5 AS language_ok, n % 11 <> 6 AS readable, CASE WHEN n % 11 = 7 THEN 10 ELSE 10000000 END AS lines FROM (SELECT p_brand AS b, min(p_partkey) AS n FROM part GROUP BY p_brand) x"""


MAPPING_STATUS = f"""SELECT anchor_id, reason, CASE WHEN reason = 'file_absent_on_side' THEN 'not_applicable' WHEN reason = 'mapping_limit' THEN 'truncated' WHEN reason = 'unsupported_language' THEN 'unsupported' WHEN reason = 'backend_failure' THEN 'failure' WHEN reason IS NULL OR reason = 'intersection_only' THEN 'mapped' ELSE 'unresolved' END AS status,
    CASE WHEN reason IS NULL OR reason = 'intersection_only' OR reason = 'mapping_limit' AND ordinal <= 1500 THEN coalesce(n, 0) ELSE 0 END AS candidates FROM (SELECT a.anchor_id, k.ordinal, g.n,
    CASE WHEN a.file_path IS NULL THEN 'file_absent_on_side' WHEN k.side = 3 THEN 'revision_absent' WHEN k.side = 4 THEN 'session_absent' WHEN k.side = 5 THEN 'binding_mismatch' WHEN a.start_line IS NULL THEN 'no_edit_range' WHEN k.ordinal > 1500 THEN 'mapping_limit' WHEN NOT f.in_scope THEN 'scope_insufficient' WHEN NOT f.fingerprinted THEN 'source_not_fingerprinted'
    WHEN NOT f.language_ok THEN 'unsupported_language' WHEN NOT f.readable THEN 'backend_failure' WHEN a.start_line > f.lines + 1 OR a.end_line > f.lines + 1 THEN 'range_outside_source' WHEN g.n > 3 THEN 'mapping_limit' WHEN g.n IS NULL THEN 'no_proven_extent' WHEN NOT g.held THEN 'intersection_only' END AS reason
    FROM anchors a JOIN (SELECT concat('a', p_partkey) AS anchor_id, p_partkey + 1 AS ordinal, p_partkey % 40 AS side FROM part) k ON k.anchor_id = a.anchor_id LEFT JOIN ({MAPPED_FILES}) f ON f.path = a.file_path LEFT JOIN (SELECT anchor_id, count(DISTINCT symbol_identity) AS n, bool_or(relation <> 'intersecting') AS held FROM ({MATCHES}) m GROUP BY 1) g ON g.anchor_id = a.anchor_id) x"""  # noqa: E501


@query(MAPPING_STATUS, "anchors", "symbol_ranges")
def mapping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_anchors(spark, sf_dir)[2].select("anchor_id", "status", "reason", "candidates")


def mapped_anchors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors on six sides, of which some are unbound, the symbols they touch, and their statuses."""
    anchors = fact(spark, sf_dir, "anchors").withColumn("ordinal", F.expr("cast(substring(anchor_id, 2) as long) + 1")).withColumn("side", F.col("ordinal") - 1).withColumn("side", F.when(F.col("side") % 40 >= 6, 0).otherwise(F.col("side") % 40))
    sides = spark.range(6).select(F.col("id").alias("side"), F.when(F.col("id") != 3, "r1").alias("revision"), (F.col("id") != 4).alias("session"), (F.col("id") != 5).alias("bound"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.min("p_partkey").alias("n"))
    c = F.col("n") % 11
    files = part.select(F.explode(F.expr("sequence(0L, 5L)")).alias("side"), F.concat(F.lit("src/"), "p_brand", F.lit(".cpp")).alias("path"), (c != 3).alias("in_scope"), (c != 4).alias("fingerprinted"), (c != 5).alias("language_ok"), (c != 6).alias("readable"), F.when(c == 7, 10).otherwise(10_000_000).alias("lines"))
    matches = changes.mapped_symbols(anchors, fact(spark, sf_dir, "symbol_ranges"))
    return anchors, matches, changes.mapping_status(anchors, matches, sides, files, None, 3, max_ranges=1500)


IMPACT = ("changes", "contexts", "dependencies", "config_inputs")


def impact_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [fact(spark, sf_dir, t) for t in IMPACT]


@query(
    """SELECT tu, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT tu, 'header' AS reason FROM dependencies WHERE path IN (SELECT path FROM changes WHERE path LIKE '%.h') UNION ALL SELECT tu, 'source' FROM contexts WHERE source IN (SELECT path FROM changes WHERE path LIKE '%.cpp')
    UNION ALL SELECT tu, 'configuration' FROM config_inputs WHERE path IN (SELECT path FROM changes) UNION ALL SELECT concat('tu:', o_orderkey), 'context' FROM orders WHERE (o_orderkey % 10 <> 0) <> (o_orderkey % 7 <> 0)) GROUP BY tu""", *IMPACT
)
def impact_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.impact(*impact_tables(spark, sf_dir))


@query("(SELECT source, tu FROM contexts WHERE side = 'old' EXCEPT SELECT source, tu FROM contexts WHERE side = 'new') UNION ALL (SELECT source, tu FROM contexts WHERE side = 'new' EXCEPT SELECT source, tu FROM contexts WHERE side = 'old')", "contexts")
def impact_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.symmetric_difference(fact(spark, sf_dir, "contexts"))


@query(
    """SELECT DISTINCT 'missing_compile_context' AS code, path, true AS requires_full_rebuild FROM changes WHERE path LIKE '%.cpp' AND path NOT IN (SELECT source FROM contexts) UNION ALL SELECT DISTINCT 'unsupported_changed_file', path, false FROM changes WHERE NOT regexp_matches(path, '[.](cpp|h)$') AND path NOT IN (SELECT path FROM config_inputs)
    UNION ALL SELECT DISTINCT 'missing_dependency_metadata', concat(side, ':', tu), true FROM contexts c WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.tu = c.tu AND d.side = c.side)""", *IMPACT
)
def impact_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.impact_diagnostics(*impact_tables(spark, sf_dir))


@query("SELECT path, count(DISTINCT tu) AS units FROM dependencies GROUP BY path", "dependencies")
def reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.reverse_dependencies(fact(spark, sf_dir, "dependencies")).select("path", F.size("units").cast("long").alias("units"))


@query("SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'removed' ELSE 'changed' END AS drift FROM files WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 UNION ALL SELECT concat('new/', path), 'added' FROM files WHERE doc_id % 50 = 1", "files")
def freshness_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fact(spark, sf_dir, "files")
    new = old.where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    new = new.union(old.where("doc_id % 50 = 1").withColumn("path", F.concat(F.lit("new/"), "path")))
    return changes.drift(files.inventory(old), files.inventory(new))


# --- snippets and metrics

SPANS = "SELECT user_id, event_id AS id, epoch_ms(ts) // 1000 AS s, epoch_ms(ts) // 1000 + CAST(floor(value * 60) AS bigint) AS e FROM events WHERE value IS NOT NULL"


@query(
    f"""SELECT user_id, id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e, id) AS bigint) AS cluster FROM (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM ({SPANS}) b WHERE b.user_id = a.user_id AND (b.s, b.e, b.id) < (a.s, a.e, a.id) AND b.e > a.s) THEN 0 ELSE 1 END AS fresh FROM ({SPANS}) a) x"""
)
def snippet_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a time without a zone counts from the same epoch in every session's zone
    naive = events.schema["ts"].dataType.typeName() == "timestamp_ntz"
    at = F.expr("86400L * unix_date(cast(ts as date)) + 3600 * hour(ts) + 60 * minute(ts) + second(ts)") if naive else F.unix_seconds("ts")
    rows = events.where("value is not null").select("user_id", F.col("event_id").alias("id"), at.alias("start"), (at + F.floor(F.col("value") * 60)).alias("end"))
    return snippets.clusters(rows, ["user_id"]).select("user_id", "id", "cluster")


@query(
    """SELECT path, line, CASE WHEN doc_id % 13 = 0 THEN 'source_hash_mismatch' WHEN doc_id % 17 = 0 THEN 'binding_mismatch' WHEN line % 9 = 0 THEN 'range_invalid' ELSE 'available' END AS status, CASE WHEN line % 9 > 0 AND doc_id % 13 > 0 AND doc_id % 17 > 0 THEN l END AS snippet
    FROM (SELECT path, doc_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files) x""",
    "files",
)
def snippet_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text as a span; every ninth one ends a column too late."""
    own = fact(spark, sf_dir, "files")
    lines = own.select("path", "doc_id", F.posexplode(F.split("content", "\n")).alias("at", "l")).withColumn("line", (F.col("at") + 1).cast("long"))
    wanted = lines.select(F.concat_ws(":", "path", "line").alias("candidate_id"), F.lit("s").alias("snapshot"), (F.col("doc_id") % 17 != 0).alias("bound"), "path", F.col("line").alias("start_line"), F.lit(1).alias("start_column"), F.col("line").alias("end_line"), (F.length("l") + F.when(F.col("line") % 9 == 0, 2).otherwise(1)).alias("end_column"), F.col("doc_id"))
    sources = own.select(F.lit("s").alias("snapshot"), "path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.lit(True).alias("readable"))
    wanted = wanted.join(sources.select("path", F.col("sha256").alias("seen")), "path").withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("seen"))).withColumn("bound", F.col("bound") | (F.col("doc_id") % 13 == 0)).drop("doc_id", "seen")
    found = materialize.snippet_statuses(wanted, sources)
    return found.select(F.substring_index("candidate_id", ":", 1).alias("path"), F.substring_index("candidate_id", ":", -1).cast("long").alias("line"), "status", "snippet")


EO = ("expected", "observed")


@query("SELECT case_id, count(*) FILTER (r <= 1) / count(*)::double AS recall_at_1, count(*) FILTER (r <= 5) / count(*)::double AS recall_at_5, count(*) FILTER (r <= 10) / count(*)::double AS recall_at_10, count(r) / count(*)::double AS recall FROM (SELECT e.case_id, e.item, (SELECT min(rank) FROM observed o WHERE o.case_id = e.case_id AND o.item = e.item) AS r FROM (SELECT DISTINCT * FROM expected) e) GROUP BY case_id", *EO)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at(*(fact(spark, sf_dir, t) for t in EO))


@query("SELECT e.case_id, coalesce(1.0::double / min(o.rank), 0.0::double) AS mrr FROM expected e LEFT JOIN observed o ON o.case_id = e.case_id AND o.item = e.item GROUP BY e.case_id", *EO)
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reciprocal_rank(*(fact(spark, sf_dir, t) for t in EO))


RELATED = "SELECT DISTINCT concat('s', l_suppkey) AS case_id, CAST(l_partkey AS varchar) AS item FROM lineitem WHERE l_returnflag = '{}'"


def relation_items(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return [rows.where(F.col("l_returnflag") == f).select(F.concat(F.lit("s"), "l_suppkey").alias("case_id"), F.col("l_partkey").cast("string").alias("item")) for f in ("R", "A")]


@query(f"SELECT case_id, count(*) FILTER (w AND NOT h) AS missing, count(*) FILTER (h AND NOT w) AS unexpected, bool_and(w AND h) AS correct FROM (SELECT case_id, item, bool_or(k = 'w') AS w, bool_or(k = 'h') AS h FROM (SELECT *, 'w' AS k FROM ({RELATED.format('R')}) a UNION ALL SELECT *, 'h' FROM ({RELATED.format('A')}) b) GROUP BY case_id, item) GROUP BY case_id")
def relation_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correctness(*relation_items(spark, sf_dir))


@query(f"SELECT case_id, count(*) FILTER (w) AS expected, count(*) FILTER (w AND h) AS present, count(*) FILTER (w AND NOT h) AS missing, count(*) FILTER (h AND NOT w) AS incorrect FROM (SELECT case_id, item, bool_or(k = 'w') AS w, bool_or(k = 'h') AS h FROM (SELECT *, 'w' AS k FROM ({RELATED.format('R')}) a UNION ALL SELECT *, 'h' FROM ({RELATED.format('A')}) b) GROUP BY case_id, item) GROUP BY case_id")
def relation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relation_coverage(*relation_items(spark, sf_dir))


@query("SELECT count(*) AS cases, avg(r) AS mean_recall, avg(m) AS mean_mrr, count(r) AS n_recall, count(m) AS n_mrr FROM (SELECT e.case_id, count(DISTINCT o.item) / count(DISTINCT e.item)::double AS r, coalesce(1.0::double / min(o.rank), 0.0::double) AS m FROM expected e LEFT JOIN observed o ON o.case_id = e.case_id AND o.item = e.item GROUP BY e.case_id)", *EO)
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = [fact(spark, sf_dir, t) for t in EO]
    return metrics.suite_summary(metrics.recall_at(*pair).join(metrics.reciprocal_rank(*pair), "case_id"), ["recall", "mrr"])


@query("SELECT concat('o', o_orderkey) AS case_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 AND coalesce((SELECT bool_and(l_returnflag <> 'R') FROM lineitem WHERE l_orderkey = o_orderkey), true) THEN 1 ELSE 0 END::bigint AS chain_correct FROM orders")
def chain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("o"), "l_orderkey").alias("case_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"), F.col("l_partkey").alias("item"), "l_returnflag")
    seen = lines.withColumn("item", F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("item")))
    states = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("incomplete").alias("status"), (F.col("o_orderkey") % 3 > 0).alias("exhaustive"), F.lit(1).alias("paths"), F.lit(0).alias("gaps"))
    return metrics.chain_correct(lines, seen, states)


FAILED_ITEMS = """SELECT concat('c', l_orderkey) AS case_id, ['file', 'symbol', 'test', 'relation'][CAST(1 + l_partkey % 4 AS bigint)] AS dimension, CAST(l_partkey AS varchar) AS item, CAST(l_partkey AS varchar) AS identity, CASE WHEN l_returnflag = 'A' AND l_partkey % 8 = 1 THEN 'odd' ELSE 'n' || CAST(l_partkey AS varchar) END AS name FROM lineitem WHERE l_returnflag {}"""


@query(
    f"""SELECT case_id, CASE WHEN error IS NOT NULL THEN error ELSE array_to_string(list_filter([CASE WHEN h = 0 AND w > 0 THEN 'empty_result' END, CASE WHEN fm > 0 THEN 'target_file_miss' END, CASE WHEN fw = 0 AND fh > 0 THEN 'unexpected_file' END, CASE WHEN sm > 0 AND sj THEN 'target_symbol_miss' END, CASE WHEN half AND sj THEN 'symbol_identity_mismatch' END,
    CASE WHEN sw = 0 AND sh > 0 AND sj THEN 'unexpected_symbol' END, CASE WHEN tm > 0 THEN 'target_test_miss' END, CASE WHEN tw = 0 AND th > 0 THEN 'unexpected_test' END, CASE WHEN rm > 0 THEN 'direct_relation_miss' END, CASE WHEN re > 0 THEN 'unexpected_direct_relation' END], lambda x: x IS NOT NULL), ',') END AS failures
    FROM (SELECT 'c' || o_orderkey AS case_id, CASE o_orderkey % 50 WHEN 0 THEN 'query_rejected' WHEN 1 THEN 'backend_unavailable' WHEN 2 THEN 'backend_failure' WHEN 3 THEN 'index_failure' WHEN 4 THEN 'unexpected_error' END AS error, o_orderkey % 3 > 0 AS sj FROM orders) o
    LEFT JOIN (SELECT case_id, sum(a)::bigint AS w, sum(b)::bigint AS h, count(*) FILTER (dimension = 'file' AND b = 0) AS fm, count(*) FILTER (dimension = 'file' AND a = 1) AS fw, count(*) FILTER (dimension = 'file' AND b = 1) AS fh, count(*) FILTER (dimension = 'symbol' AND b = 0) AS sm, count(*) FILTER (dimension = 'symbol' AND a = 1) AS sw, count(*) FILTER (dimension = 'symbol' AND b = 1) AS sh,
    count(*) FILTER (dimension = 'test' AND b = 0) AS tm, count(*) FILTER (dimension = 'test' AND a = 1) AS tw, count(*) FILTER (dimension = 'test' AND b = 1) AS th, count(*) FILTER (dimension = 'relation' AND b = 0) AS rm, count(*) FILTER (dimension = 'relation' AND a = 0) AS re
    FROM (SELECT case_id, dimension, item, max(a) AS a, max(b) AS b FROM (SELECT case_id, dimension, item, 1 AS a, 0 AS b FROM ({FAILED_ITEMS.format("<> 'A'")}) x UNION ALL SELECT case_id, dimension, item, 0, 1 FROM ({FAILED_ITEMS.format("<> 'R'")}) y) GROUP BY ALL) GROUP BY case_id) c ON c.case_id = o.case_id
    LEFT JOIN (SELECT DISTINCT x.case_id AS hc, true AS half FROM ({FAILED_ITEMS.format("<> 'A'")}) x JOIN ({FAILED_ITEMS.format("<> 'R'")}) y ON x.case_id = y.case_id AND x.dimension = 'symbol' AND y.dimension = 'symbol' AND (x.identity = y.identity) <> (x.name = y.name)) h ON h.hc = o.case_id""".replace("SELECT case_id, CASE WHEN error", "SELECT o.case_id, CASE WHEN error")
)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, c = F.col("o_orderkey") % 50, F.col
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("c"), "l_orderkey").alias("case_id"), F.element_at(F.array(*map(F.lit, metrics.DIMENSIONS)), (1 + c("l_partkey") % 4).cast("int")).alias("dimension"), c("l_partkey").cast("string").alias("item"), c("l_partkey").cast("string").alias("identity"), F.when((c("l_returnflag") == "A") & (c("l_partkey") % 8 == 1), "odd").otherwise(F.concat(F.lit("n"), "l_partkey")).alias("name"), "l_returnflag")
    cases = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c"), "o_orderkey").alias("case_id"), F.when(key < 5, F.element_at(F.array(*map(F.lit, metrics.ERRORS)), (key + 1).cast("int"))).alias("error"), F.when(c("o_orderkey") % 3 > 0, F.array(*map(F.lit, metrics.DIMENSIONS))).otherwise(F.array(*map(F.lit, ("file", "test", "relation")))).alias("evaluated"))
    return metrics.failure_classes(cases, lines.where("l_returnflag <> 'A'"), lines.where("l_returnflag <> 'R'"))


@query("SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'not_covered' WHEN quality = 1 THEN 'complete' ELSE 'partial' END AS status, count(*) AS n, sum(d.n_chars)::bigint AS chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "lang", F.col("n_chars").alias("chars")).join(labels.select("doc_id", F.col("quality").alias("covered")), "doc_id", "left")
    return metrics.coverage_counts(rows, ["lang"], "chars")


# --- parsers: rows only, or against what the generated text says

@query("SELECT concat('d', n_nationkey) AS diff_id, 'ok' AS status, CASE WHEN n_nationkey % 5 = 0 THEN 3 ELSE 4 END::bigint AS rows FROM nation WHERE n_nationkey % 7 > 0 UNION ALL SELECT concat('d', n_nationkey), 'invalid', 1 FROM nation WHERE n_nationkey % 7 = 0")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    body = F.when(n % 5 == 0, "@@ -1,1 +1,2 @@\n a\n+b\n+c\n".replace("+1,2", "+1,3")).otherwise("@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n".replace("-1,2", "-1,2"))
    text = F.concat(F.lit("--- x/"), "n_name", F.lit("\n+++ x/"), "n_name", F.lit("\n"), body, F.when(n % 7 == 0, "?\n").otherwise(""))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("d"), "n_nationkey").alias("diff_id"), F.translate(text, " ", " ").alias("content"))
    return diffs.diff_lines(rows).groupBy("diff_id", "status").agg(F.count("*").alias("rows"))


@query("SELECT concat('t/', n_nationkey, '.cpp') AS file_path, 'fixture' AS kind, concat('F', n_regionkey) AS display_name, false AS with_body FROM nation UNION ALL SELECT concat('t/', n_nationkey, '.cpp'), 'case', concat('C', n_nationkey), n_nationkey % 3 > 0 FROM nation")
def test_macro_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = F.concat(F.lit("class F"), "n_regionkey", F.lit(" {};\n// TEST_F(No, No) {}\nTEST_F(F"), "n_regionkey", F.lit(", C"), "n_nationkey", F.lit(') { auto s = "}"; '), F.when(n % 3 > 0, "}\n").otherwise("\n"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("t/"), "n_nationkey", F.lit(".cpp")).alias("path"), text.alias("content"))
    return tests.discover(rows).select("file_path", "kind", "display_name", F.col("body_end").isNotNull().alias("with_body"))


@query("SELECT concat('d/', o_orderkey, '.d') AS path, concat('obj/', o_orderkey, '.o') AS target, unnest([concat('src/', o_orderkey, '.cpp'), concat('a b/', o_custkey, '.h')]) AS dependency FROM orders")
def depfile_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("d/"), "o_orderkey", F.lit(".d")).alias("path"), F.concat(F.lit("obj/"), "o_orderkey", F.lit(".o: src/"), "o_orderkey", F.lit(".cpp \\\n  a\\ b/"), "o_custkey", F.lit(".h\n")).alias("content"))
    return files.depfile_rules(rows)




from factgraph.plans import service_queries, trace_queries  # noqa: E402, F401  (they register their queries here)
