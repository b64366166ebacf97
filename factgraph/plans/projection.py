"""Fact tables out of the driver's tables. The same SQL text serves Spark and DuckDB; ``{name}`` stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.sources.workspace import dealt

EVENT_LINES = "SELECT event_id, user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS line FROM {events}"
FACTS = {
    "files": "SELECT concat('doc/', lang, '/', lpad(CAST(doc_id AS string), 8, '0'), '.txt') AS path, text AS content, doc_id, lang FROM {documents}",
    "symbols": """SELECT concat('region:', r_regionkey) AS identity, 'namespace' AS kind, r_name AS display_name, r_name AS qualified_name, CAST(NULL AS string) AS parent_identity, CAST(NULL AS string) AS namespace_identity FROM {region}
        UNION ALL SELECT concat('nation:', n_nationkey), 'class', n_name, concat(r_name, '::', n_name), concat('region:', n_regionkey), concat('region:', n_regionkey) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('supplier:', s_suppkey), 'struct', s_name, concat(n_name, '::', s_name), concat('nation:', s_nationkey), NULL FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION ALL SELECT concat('customer:', c_custkey), 'class', c_name, concat(n_name, '::', c_name), concat('nation:', c_nationkey), NULL FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL SELECT concat('part:', p_partkey), 'function', p_name, concat(p_brand, '::', p_name), NULL, NULL FROM {part}""",
    "symbol_ranges": """SELECT concat('part:', p_partkey) AS symbol_identity, 'declaration' AS role, concat('src/', p_brand, '.cpp') AS file_path, CAST(10 * p_partkey + 1 AS bigint) AS start_line, CAST(1 AS bigint) AS start_column, CAST(10 * p_partkey + 1 + p_size AS bigint) AS end_line, CAST(1 AS bigint) AS end_column FROM {part}
        UNION ALL SELECT concat('part:', p_partkey), 'definition', concat('src/', p_brand, '.cpp'), CAST(10 * p_partkey + 2 AS bigint), 1, CAST(10 * p_partkey + 4 + p_size AS bigint), 1 FROM {part} WHERE p_size % 2 = 0
        UNION ALL SELECT concat('region:', r_regionkey), 'declaration', concat('src/region', r_regionkey, '.h'), 1, 1, 2000, 1 FROM {region}
        UNION ALL SELECT concat('nation:', n_nationkey), 'declaration', concat('src/region', n_regionkey, '.h'), CAST(40 * n_nationkey + 1 AS bigint), 1, CAST(40 * n_nationkey + 31 AS bigint), 1 FROM {nation}
        UNION ALL SELECT concat('supplier:', s_suppkey), 'definition', concat('src/nation', s_nationkey, '.cpp'), CAST(s_suppkey + 1 AS bigint), 1, CAST(s_suppkey + 2 AS bigint), 1 FROM {supplier}
        UNION ALL SELECT concat('customer:', c_custkey), 'definition', concat('src/nation', c_nationkey, '.cpp'), CAST(c_custkey + 100001 AS bigint), 1, CAST(c_custkey + 100002 AS bigint), 1 FROM {customer}""",
    "symbol_references": "SELECT DISTINCT concat('part:', l_partkey) AS symbol_identity, concat('order/', l_orderkey) AS file_path, CAST(l_linenumber AS bigint) AS start_line, CAST(1 AS bigint) AS start_column, CAST(l_linenumber AS bigint) AS end_line, CAST(5 AS bigint) AS end_column FROM {lineitem}",
    "symbol_relations": """SELECT DISTINCT concat('supplier:', l_suppkey) AS source_identity, 'callee' AS relation_kind, concat('part:', CASE WHEN l_partkey % 97 = 0 THEN l_partkey + 1000000 ELSE l_partkey END) AS target_identity FROM {lineitem}
        UNION SELECT DISTINCT concat('part:', l_partkey), 'caller', concat('supplier:', l_suppkey) FROM {lineitem}""",
    "event_lines": EVENT_LINES,
    "test_entities": f"""SELECT DISTINCT concat('fixture:', user_id) AS identity, 'fixture' AS kind, concat('user', user_id) AS display_name, concat('user/', user_id) AS file_path, CAST(1 AS bigint) AS start_line, CAST(1 AS bigint) AS start_column, CAST(1 AS bigint) AS end_line, CAST(2 AS bigint) AS end_column FROM {{events}}
        UNION ALL SELECT concat('case:', event_id), 'case', concat('case', event_id % 50), concat('user/', user_id), line, 1, line, 9 FROM ({EVENT_LINES}) e WHERE event_type = 'purchase'""",
    "test_fixture_cases": "SELECT concat('fixture:', user_id) AS fixture_identity, concat('case:', event_id) AS case_identity FROM {events} WHERE event_type = 'purchase'",
    "test_case_bodies": f"""SELECT concat('case:', event_id) AS case_identity, concat('user/', user_id) AS file_path, line AS start_line, CAST(1 AS bigint) AS start_column, CAST(coalesce(lead(line) OVER (PARTITION BY user_id ORDER BY line), line + 1000) AS bigint) AS end_line, CAST(1 AS bigint) AS end_column FROM ({EVENT_LINES}) e WHERE event_type = 'purchase'""",
    "event_references": f"SELECT concat('type:', event_type) AS symbol_identity, concat('user/', user_id) AS file_path, line AS start_line, CAST(1 AS bigint) AS start_column, line AS end_line, CAST(5 AS bigint) AS end_column FROM ({EVENT_LINES}) e WHERE event_type <> 'purchase'",
    "edges": """SELECT 'symbol' AS src_ns, concat('region:', n_regionkey) AS src_key, 'symbol' AS dst_ns, concat('nation:', n_nationkey) AS dst_key, 'declare' AS relation FROM {nation}
        UNION ALL SELECT 'symbol', concat('nation:', s_nationkey), 'symbol', concat('supplier:', s_suppkey), 'define' FROM {supplier}
        UNION ALL SELECT 'symbol', concat('nation:', c_nationkey), 'symbol', concat('customer:', c_custkey), 'define' FROM {customer}
        UNION SELECT DISTINCT 'symbol', concat('supplier:', l_suppkey), 'symbol', concat('part:', l_partkey), 'call' FROM {lineitem}""",
    "rules": """SELECT concat('r', n_nationkey) AS rule_id, 'pattern' AS role, concat(r_name, '::', n_name) AS qualified_name, CASE WHEN n_nationkey % 5 = 4 THEN 'src/other.h' ELSE concat('src/region', n_regionkey, '.h') END AS file_path, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE r_name END AS component FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 1
        UNION ALL SELECT concat('x', n_nationkey), 'model', concat(r_name, '::', n_name), concat('src/region', n_regionkey, '.h'), r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 6 = 0""",
    "tasks": "SELECT CAST(n_nationkey AS bigint) AS task_id, concat('[component:', n_name, '] fix [symbol: ', r_name, '::', n_name, ' ] now', CASE WHEN n_nationkey % 2 = 0 THEN ' [action:]' ELSE '' END) AS text FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "diff_lines": "SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'add' ELSE 'context' END AS kind, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_returnflag) AS bigint) AS seq, CAST(1 AS bigint) AS old_start, CAST(1 AS bigint) AS new_start FROM {lineitem}",
    "anchors": "SELECT concat('a', p_partkey) AS anchor_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('src/', p_brand, '.cpp') END AS file_path, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(10 * p_partkey + 3 AS bigint) END AS start_line, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(10 * p_partkey + 3 + p_size % 4 AS bigint) END AS end_line FROM {part}",
    "contexts": """SELECT concat('tu:', o_orderkey) AS tu, concat('order/', o_orderkey, '.cpp') AS source, 'old' AS side FROM {orders} WHERE o_orderkey % 10 <> 0
        UNION ALL SELECT concat('tu:', o_orderkey), concat('order/', o_orderkey, '.cpp'), 'new' FROM {orders} WHERE o_orderkey % 7 <> 0""",
    "dependencies": "SELECT DISTINCT concat('tu:', l_orderkey) AS tu, concat('part/', l_partkey, '.h') AS path, 'old' AS side FROM {lineitem} UNION ALL SELECT DISTINCT concat('tu:', l_orderkey), concat('part/', l_partkey, '.h'), 'new' FROM {lineitem} WHERE l_orderkey % 11 <> 0",
    "config_inputs": "SELECT concat('tu:', o_orderkey) AS tu, concat('cfg/', o_orderstatus, '.cfg') AS path FROM {orders}",
    "changes": """SELECT concat('part/', p_partkey, '.h') AS path FROM {part} WHERE p_size = 1 UNION ALL SELECT concat('order/', o_orderkey, '.cpp') FROM {orders} WHERE o_orderkey % 100 = 5
        UNION ALL SELECT 'cfg/P.cfg' FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT concat('note/', r_regionkey, '.md') FROM {region}""",
    "expected": "SELECT d.lang AS case_id, CAST(d.doc_id AS string) AS item FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 1",
    "observed": "SELECT lang AS case_id, CAST(doc_id AS string) AS item, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS bigint) AS rank FROM {documents}",
    "paths": """SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'build/x' ELSE 'lib/Out' END, '/', CASE p_partkey % 3 WHEN 0 THEN 'test_' ELSE 'mod_' END, p_partkey, CASE p_size % 6 WHEN 0 THEN '.cpp' WHEN 1 THEN '.h' WHEN 2 THEN '.txt' WHEN 3 THEN '_test.cc' WHEN 4 THEN '.HPP' ELSE '' END) AS path FROM {part}""",
}
SOURCES = re.compile(r"\{(\w+)\}")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the SQL of edges, made distinct once and in partitions of bounded size, where its two unions are two passes over shares of the table."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ends = (("nation", "region", "n_regionkey", "nation", "n_nationkey", "declare"), ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "define"), ("customer", "nation", "c_nationkey", "customer", "c_custkey", "define"), ("lineitem", "supplier", "l_suppkey", "part", "l_partkey", "call"))
    out = None
    for name, src, src_key, dst, dst_key, relation in ends:
        rows = table(name).select(F.lit("symbol").alias("src_ns"), F.concat(F.lit(f"{src}:"), src_key).alias("src_key"), F.lit("symbol").alias("dst_ns"), F.concat(F.lit(f"{dst}:"), dst_key).alias("dst_key"), F.lit(relation).alias("relation"))
        out = rows if out is None else out.union(rows)
    return dealt(out, sum(table(name).count() for name, *_ in ends), "src_key", "dst_key").distinct()


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the SQL of dependencies, dealt once by their units in partitions of bounded size."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lambda of, side: of.select(F.concat(F.lit("tu:"), "l_orderkey").alias("tu"), F.concat(F.lit("part/"), "l_partkey", F.lit(".h")).alias("path"), F.lit(side).alias("side"))
    n = line.count()
    old, new = (dealt(rows(of, side), n, "tu").distinct() for of, side in ((line, "old"), (line.where("l_orderkey % 11 <> 0"), "new")))
    return old.union(new)


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact table as a DataFrame over the folder's Parquet."""
    if name in ("edges", "dependencies"):
        return {"edges": edges, "dependencies": dependencies}[name](spark, sf_dir)
    sql = FACTS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(SOURCES.findall(sql))})


def duck_text(sql: str) -> str:
    """The same SQL for DuckDB, where tables go by their names."""
    return SOURCES.sub(r"\1", sql)


def duck(name: str) -> str:
    return duck_text(FACTS[name])


def oracle(sql: str, *facts: str) -> str:
    """DuckDB SQL over the named facts."""
    head = ", ".join(f"{f} AS ({duck(f)})" for f in facts)
    if head and sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {head} {sql}" if head else sql
