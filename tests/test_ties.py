"""Rows that an order leaves tied, null keys and time zones, against the queries' SQL; requests and searches without bounds."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from factgraph.operators import graph, service
from factgraph.operators.retrieval import Bounds
from factgraph.plans import queries, service_queries

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_snippet_clusters_of_repeated_events(spark, zone, tmp_path):
    events = [(1, "2024-03-10 01:59:30", 7, 2.0), (2, "2024-03-10 02:30:00", 7, 1.0), (3, "2024-03-10 03:00:10", 7, 1.0), (3, "2024-03-10 03:00:10", 7, 1.0), (4, "2024-03-10 03:00:50", 7, 1.0), (5, "2024-03-10 04:00:00", 7, 0.0), (5, "2024-03-10 04:00:00", 7, 0.0)]
    events += [(6, "2024-03-10 05:00:00", 7, 9.0), (7, "2024-03-10 05:00:01", 7, 1.0), (7, "2024-03-10 05:00:01", 7, 1.0), (8, "2024-03-10 01:00:00", None, 9.0), (9, "2024-03-10 01:00:01", None, 9.0), (10, None, 7, 1.0)]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id bigint, ts timestamp, user_id bigint, value double)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", events)
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    key = lambda r: tuple((x is None, x) for x in r)
    theirs = sorted(c.execute(f"SELECT user_id, id, cluster FROM ({queries.ORACLES['snippet_clusters']}) q").fetchall(), key=key)
    mine = sorted((tuple(r) for r in queries.QUERIES["snippet_clusters"](spark, str(tmp_path)).collect()), key=key)
    assert mine == theirs


@pytest.mark.skipif(not FOLDER.exists(), reason="the tables aren't here")
def test_requests_without_bounds(spark):
    """Nothing is cut, where the bounds that are set by default cut."""
    own = service_queries.name_queries(spark, str(FOLDER)).where("channel = 'symbol' or channel = 'graph_outgoing'")
    facts = service_queries.service_facts(spark, str(FOLDER))
    found = service.retrieve(own, facts, bounds=service_queries.WIDE)
    kept = found.reports.groupBy("status").sum("observed", "kept").collect()
    assert not found.truncated and all(r["status"] == "ok" and r[1] == r[2] for r in kept)
    assert None in (service_queries.WIDE.candidates, Bounds(candidates=None).candidates)


def test_breadth_first_search_without_bounds(spark, monkeypatch):
    """Nothing is turned away, where the bounds that are set by default turn away; the query sets none."""
    nodes = spark.range(1201).selectExpr("'n' as namespace", "concat('k', id) as key")
    edges = spark.range(1, 1201).selectExpr("'n' as src_ns", "'k0' as src_key", "'n' as dst_ns", "concat('k', id) as dst_key", "'call' as relation")
    found = graph.traverse(nodes, edges, "n", "k0", 1, max_nodes=None, max_edges=None)
    assert (found.visits.count(), found.edges.count(), found.stopped_by) == (1201, 1200, None)
    assert graph.traverse(nodes, edges, "n", "k0", 1, max_nodes=None, max_edges=7).stopped_by == "edge_limit"
    asked = []
    monkeypatch.setattr(graph, "traverse", lambda *args, max_nodes=0, max_edges=0: asked.append((len(args), max_nodes, max_edges)) or found)
    queries.QUERIES["graph_bfs_depth"](spark, str(FOLDER))
    assert asked == [(5, None, None)]


@pytest.mark.skipif(not FOLDER.exists(), reason="the tables aren't here")
def test_requests_without_bounds_write_no_facts(spark, monkeypatch):
    """Only queries and the symbols that they name are written; candidates are those of bounds that nothing reaches."""
    own = service_queries.name_queries(spark, str(FOLDER)).where("channel = 'symbol' or channel = 'graph_node' or channel = 'definition'")
    facts = service_queries.service_facts(spark, str(FOLDER))
    columns = []
    monkeypatch.setattr(service, "written", lambda df, write=service.written: columns.append(df.columns) or write(df))
    found = service.retrieve(own, facts, bounds=service_queries.WIDE)
    assert len(columns) == 2 and not any("fact_key" in c for c in columns)
    wide = Bounds(queries=10**6, names=10**6, results_per_query=10**6, records_per_query=10**6, candidates_per_channel=10**6, candidates=10**6)
    same = service.retrieve(own, facts, bounds=wide)
    for a, b in ((found.reports, same.reports), (found.candidates, same.candidates)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
