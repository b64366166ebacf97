"""Shares of a task that don't grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.operators import changes, graph, index, textsearch
from factgraph.plans import projection
from factgraph.sources import dependencies, workspace

SMALL = "/root/testdata/sf0.001"


def test_edges_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(workspace, "DEALT", 500)
    found = projection.fact(spark, SMALL, "edges")
    tables = ("nation", "supplier", "customer", "lineitem")
    n = sum(spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in tables)
    assert found.rdd.getNumPartitions() == -(-n // 500) > 10
    sql = spark.sql(projection.FACTS["edges"], **{t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in tables})
    assert found.schema.names == sql.schema.names and found.dtypes == sql.dtypes
    assert found.exceptAll(sql).isEmpty() and sql.exceptAll(found).isEmpty()


def test_conflicts_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(workspace, "DEALT", 100)
    rows = spark.range(1000).select((F.col("id") % 400).alias("id"), F.when(F.col("id") < 401, 0).otherwise(F.col("id")).alias("x"))
    found = index.conflicting(rows.union(rows), "id")
    assert found.rdd.getNumPartitions() == 20
    assert {(r.id, r.n) for r in found.collect()} == {(i, 3 if 0 < i < 200 else 2) for i in range(400) if i} | {(0, 2)}


def test_limit_sends_only_first_paths(spark):
    rows = [(f"p{i:03}", f"the {i} The\nno\nTHE") for i in range(50)] + [("p001", "the 1 The\nno\nTHE"), ("p000", "other the")]
    files = spark.createDataFrame(rows, "path string, content string")
    whole = textsearch.search(files, textsearch.TextQuery("THE", case_sensitive=False))
    expected = [tuple(r) for r in whole.orderBy(*textsearch.RESULT[:6]).limit(7).collect()]
    few = textsearch.search(files, textsearch.TextQuery("THE", case_sensitive=False, limit=7))
    assert [tuple(r) for r in few.collect()] == expected
    # matches are kept to those paths before they are dealt out to be made distinct
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate [path") < plan.index("LeftSemi")


def test_a_projection_tells_its_nodes_without_the_places_of_references(spark):
    tables = [projection.fact(spark, SMALL, t) for t in ("symbols", "symbol_ranges", "symbol_references", "symbol_relations", "test_entities", "test_fixture_cases")]
    met = index.contained_references(projection.fact(spark, SMALL, "event_references"), projection.fact(spark, SMALL, "test_case_bodies"))
    nodes, evidence = graph.project(*tables, met)
    # references are dealt out by their ends alone, not by lines as well
    dealt = [line for line in nodes._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert dealt and not any("start_line" in line or "l_linenumber" in line for line in dealt)
    assert evidence.count() == evidence.distinct().count() and nodes.count() == nodes.select("namespace", "key").distinct().count()


def test_units_without_dependencies_are_told_in_shares_of_rows(spark, monkeypatch):
    monkeypatch.setattr(workspace, "DEALT", 100)
    contexts, known = projection.fact(spark, SMALL, "contexts"), projection.fact(spark, SMALL, "dependencies")
    line = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    sql = spark.sql(projection.FACTS["dependencies"], lineitem=line)
    assert known.rdd.getNumPartitions() >= -(-line.count() // 100)
    assert known.dtypes == sql.dtypes and known.exceptAll(sql).isEmpty() and sql.exceptAll(known).isEmpty()
    nothing = spark.createDataFrame([], "path string")
    found = changes.impact_diagnostics(nothing, contexts, known, spark.createDataFrame([], "tu string, path string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{-(-contexts.count() // 100)}), REPARTITION_BY_NUM") >= 2
    want = contexts.select("tu", "side").distinct().join(sql.select("tu", "side").distinct(), ["tu", "side"], "left_anti")
    assert {r.path for r in found.collect()} == {f"{r.side}:{r.tu}" for r in want.collect()} != set()


def test_closures_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(workspace, "DEALT", 10)
    contexts = spark.createDataFrame([(f"t{i}", f"s{i // 2}.cpp") for i in range(200)], "tu string, source string")
    by_unit = contexts.where("tu <> 't7'").select("tu", F.concat(F.lit("d/"), "tu").alias("depfile"))
    depfiles = by_unit.where("tu <> 't8'").select(F.col("depfile").alias("path"), F.concat(F.lit("x.o: a.h a.h /usr/b.h "), "tu", F.lit(".h\n")).alias("content"))
    assert dependencies.registered(contexts, by_unit, by_unit.limit(0).select(F.lit("").alias("source"), "depfile"))._jdf.queryExecution().optimizedPlan().toString().count(", 20") >= 1
    rows, notes = dependencies.closures(contexts, by_unit, by_unit.limit(0).select(F.lit("").alias("source"), "depfile"), depfiles)
    assert rows.rdd.getNumPartitions() == 20
    assert {tuple(r) for r in rows.collect()} == {(f"t{i}", p) for i in range(200) if i not in (7, 8) for p in ("a.h", f"t{i}.h", f"s{i // 2}.cpp")}
    assert {tuple(r) for r in notes.collect()} == {(f"t{i}", "outside_repository_dependency", 1) for i in range(200) if i not in (7, 8)} | {("t7", "missing_dependency_metadata", 1), ("t8", "malformed_metadata", 1)}
