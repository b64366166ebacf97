"""Joins of tables that may be large on both sides don't pass either through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.operators import changes, intervals


def broadcast(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_overlapping_ranges(spark):
    a = spark.createDataFrame([("f", 1, 3), ("f", 9, 9)], "file string, lo long, hi long")
    b = spark.createDataFrame([("f", 2, 40), ("g", 1, 3)], "path string, lo long, hi long")
    met = intervals.overlapping(a, b, [("file", "path")], ("lo", "hi"), ("lo", "hi"))
    assert broadcast(met) == 0
    assert sorted((r.left.lo, r.right.lo) for r in met.collect()) == [(1, 2), (9, 2)]


def test_seeds_of_anchors(spark):
    anchors = spark.createDataFrame([("a1", "old"), ("a2", "new")], "anchor_id string, side string")
    matches = spark.createDataFrame([("a1", "s1"), ("a1", "s1"), ("a2", "s2")], "anchor_id string, symbol_identity string")
    statuses = spark.createDataFrame([("a1", "mapped"), ("a2", "failure")], "anchor_id string, status string")
    seeds = changes.mapping_seeds(statuses, matches, anchors)
    assert broadcast(seeds) == 0
    assert [tuple(r) for r in seeds.collect()] == [("old", "symbol", "s1")]


def test_statuses_of_anchors(spark):
    anchors = spark.createDataFrame([("a1", 1, 0, "f", 1, 2), ("a2", 2, 0, None, 1, 2)], "anchor_id string, ordinal long, side long, file_path string, start_line long, end_line long")
    matches = spark.createDataFrame([("a1", "s1", "enclosing")], "anchor_id string, symbol_identity string, relation string")
    sides = spark.range(1).select(F.col("id").alias("side"), F.lit("r").alias("revision"), F.lit(True).alias("session"), F.lit(True).alias("bound"))
    files = spark.createDataFrame([(0, "f", True, True, True, True, 10)], "side long, path string, in_scope boolean, fingerprinted boolean, language_ok boolean, readable boolean, lines long")
    found = changes.mapping_status(anchors, matches, sides, files)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [anchor_id" in plan
    assert sorted((r.anchor_id, r.status, r.candidates) for r in found.collect()) == [("a1", "mapped", 1), ("a2", "not_applicable", 0)]
