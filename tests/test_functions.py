from __future__ import annotations

import json
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from factgraph.functions import identity, paths, ranges

PATHS = ["a.cpp", "src/a.cpp", "src/x/b.H", "tests/c.cc", "x/test_d.cxx", "x/e_unittest.cpp", "Build/y/f.c", "a/.git/g.h", "README", ".hidden", "x/.cpp", "d/e.tar.inc", "o[1]/k.cpp"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def test_classes_and_excluded(frame):
    got = {r.path: (r.t, r.x) for r in frame.select("path", paths.file_type("path").alias("t"), paths.excluded_directory("path").alias("x")).collect()}
    assert [got[p][0] for p in PATHS] == ["source", "source", "header", "test", "test", "test", "source", "header", "other", "other", "other", "header", "source"]
    assert got["Build/y/f.c"][1] == "Build" and got["a/.git/g.h"][1] == ".git" and got["a.cpp"][1] is None


@pytest.mark.parametrize("glob", ["*.cpp", "**/*.cpp", "src/*.cpp", "x/*", "?.cpp", "[ab].cpp", "[!a].cpp", "o[[]1]/*", "src/*/*.H"])
def test_globs(frame, glob):
    got = {r[0] for r in frame.where(paths.matches_any("path", [paths.component_pattern(glob)])).collect()}
    assert got == {p for p in PATHS if PurePosixPath(p).match(glob)}
    got = {r[0] for r in frame.where(paths.matches_any("path", [paths.whole_pattern(glob)])).collect()}
    assert got == {p for p in PATHS if fnmatchcase(p, glob)}


def test_valid_paths_and_scopes(spark, frame):
    bad = ["/a", "../a", "a/../b", "a\\b", "", "a//b", "a/", "./a", "C:/x"]
    assert spark.createDataFrame([(p,) for p in bad], "path string").where(paths.valid("path")).count() == 0
    assert frame.where(~paths.valid("path")).count() == 0
    assert {r[0] for r in frame.where(paths.in_scope("path", "src")).collect()} == {"src/a.cpp", "src/x/b.H"}
    assert frame.where(paths.in_scope("path", ".")).count() == len(PATHS)


@pytest.mark.parametrize("text", ["plain", 'a"b\\c', "tab\tline\n", "é日", "😀 x", "\x7f\x01"])
def test_canonical_json(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(identity.node_value(F.lit("symbol"), F.col("t"))).first()[0]
    assert got == "graph-node:v1:" + json.dumps(["symbol", text], ensure_ascii=True, separators=(",", ":"))


def test_extent_relations(spark):
    rows = [(3, 3, 1, 5, "point_interior"), (1, 1, 1, 5, None), (5, 5, 1, 5, None), (2, 4, 1, 5, "enclosing"), (1, 5, 1, 5, "enclosing"), (0, 3, 1, 5, "intersecting"), (5, 8, 1, 5, None), (0, 9, 4, 4, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want string").select("want", *(F.struct(F.col(x).alias("line"), F.lit(1).alias("column")).alias(x) for x in "abcd"))
    assert all(r.want == r.got for r in df.withColumn("got", ranges.extent_relation(*map(F.col, "abcd"))).collect())
